"""The funding rule and its inverse, as column expressions.

A venue pays F = P + clamp(r - P, -c, +c), with P the premium over eight hours, r the interest
floor and c the clamp. Rates and premiums of eight hours are in raw units or in basis points
(1 bp = 1e-4); an hourly venue pays F / 8 an hour.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values
FLOOR_8H = "0.0001"
FLOOR_HOURLY = "0.0000125"
CLAMP = "0.0005"
CLAMP_OLD = "0.0003"
TOLERANCE = "0.00000001"
BAND_BPS = (-4.0, 6.0)
SETTLEMENT_HOURS = (0, 8, 16)
RATE = "decimal(20,12)"


def rate(text: Column) -> Column:
    """Exact decimal of a printed rate; surrounding blanks and exponents are accepted, anything else is null."""
    return F.trim(text.cast("string")).try_cast(RATE)


def literal(value: str) -> Column:
    return F.lit(value).cast(RATE)


def funding_8h(premium: Column, floor: Column, clamp: Column) -> Column:
    """P + clamp(r - P, -c, c)."""
    return premium + F.greatest(F.least(floor - premium, clamp), -clamp)


def hourly_bps(premium_bps: Column) -> Column:
    """What an hourly venue pays in an hour, in bps, at a premium over eight hours in bps."""
    return funding_8h(premium_bps, F.lit(1.0), F.lit(5.0)) / 8


def clamp_binds(funding_bps: Column, tolerance: float = 0.001) -> Column:
    """Whether an hourly rate in bps lies at the floor, within a tolerance."""
    return F.abs(funding_bps - 0.125) < tolerance


def recovered_premium_bps(exact_rate: Column, floor: Column = None, clamp: Column = None) -> Column:
    """The premium in bps behind an exact eight-hour rate; null at the floor, where the clamp hides it."""
    floor, clamp = literal(FLOOR_8H) if floor is None else floor, literal(CLAMP) if clamp is None else clamp
    return F.when(exact_rate < floor, (exact_rate - clamp) * 10000).when(exact_rate > floor, (exact_rate + clamp) * 10000).cast("double")


def in_band(premium_bps: Column) -> Column:
    """1.0 inside the closed band where the clamp hides the premium, 0.0 outside, null for null."""
    return F.when(premium_bps.isNotNull(), premium_bps.between(*BAND_BPS).cast("double"))


def at_settlement(time: Column) -> Column:
    return F.hour(time).isin(*SETTLEMENT_HOURS) & (F.minute(time) == 0)


def phase(median_bps: Column) -> Column:
    """Where a median premium lies: below the band, in its lower half, or above."""
    return F.when(median_bps <= BAND_BPS[0], "below").when(median_bps <= 0, "lower").when(median_bps > 0, "upper")


def rule_label(deviation: Column, at_floor: Column) -> Column:
    """What a record reveals of the rule; ``deviation``: eight-hour rate less premium, exact."""
    near = lambda c: F.abs(F.abs(deviation) - literal(c)) <= literal(TOLERANCE)
    return F.when(at_floor, "floor").when(near(CLAMP), "clamp_5bp").when(near(CLAMP_OLD), "clamp_3bp").when(near("0"), "unclamped").otherwise("other")


def whole_bps(deviation: Column) -> Column:
    """The whole number of bps that |deviation| equals within 1e-8, or null."""
    c = F.round(F.abs(deviation) * 10000).cast("int")
    return F.when((c >= 1) & (F.abs(F.abs(deviation) - c.cast(RATE) * literal("0.0001")) <= literal(TOLERANCE)), c)
