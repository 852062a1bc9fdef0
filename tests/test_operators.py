"""Operators against plain Python on random data, and the laws they keep."""

import itertools
import math
import statistics
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import funding as X, periods as P, ratios as R
from tidemark.operators import censoring as C, gap as G, islands as I, panel as J, resample as S, stats as T

START = datetime(2023, 3, 7)


def hours(n, step=1):
    return [START + timedelta(hours=step * i) for i in range(n)]


def keyed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("k", F.lit(1))


def daily(spark, values):
    days = [date(2023, 3, 7) + timedelta(days=i) for i in range(len(values))]
    return keyed(spark, [(d, float(v)) for d, v in zip(days, values) if v is not None], "day date, v double"), days


# the funding rule -----------------------------------------------------------------------------


def test_floor_counts_compare_printed_digits(spark):
    g = np.random.default_rng(1)
    exact = [Decimal(int(x)) / Decimal(10**8) for x in g.integers(9_990, 10_010, 200)]
    shown = [f"{x:.{int(p)}f}" for x, p in zip(exact, g.integers(8, 13, 200))] + ["text", ""]
    got = C.floor_counts(keyed(spark, [(s,) for s in shown], "s string"), ["k"], X.rate(F.col("s")), X.literal(X.FLOOR_8H)).first()
    floor = Decimal("0.0001")
    assert (got["below"], got["at"], got["above"]) == (sum(x < floor for x in exact), sum(x == floor for x in exact), sum(x > floor for x in exact))
    assert got["n"] == 200 and got["share_at"] == pytest.approx(got["at"] / 200)


def test_premium_and_rate_undo_each_other(spark):
    """Off the floor a rate gives its premium back; on it the premium is hidden."""
    premiums = [Decimal(i) / Decimal(10**6) for i in range(-900, 1300, 7)]
    rates = [p + max(min(Decimal("0.0001") - p, Decimal("0.0005")), Decimal("-0.0005")) for p in premiums]
    rows = spark.createDataFrame([(float(p), str(r)) for p, r in zip(premiums, rates)], "p double, s string")
    for r in rows.select("p", X.recovered_premium_bps(X.rate(F.col("s"))).alias("back")).collect():
        inside = -0.0004 <= r.p <= 0.0006
        assert r.back is None if inside else r.back == pytest.approx(1e4 * r.p)


def test_spans_by_their_ends(spark):
    stamps = hours(60)
    bounds = [("a", stamps[3], stamps[20], True), ("b", stamps[20], stamps[41], False), ("c", stamps[10], stamps[12], True)]
    spans = P.spans(spark, [(n, str(lo), str(hi), closed) for n, lo, hi, closed in bounds])
    got = {(r.span, r.time) for r in P.in_spans(spark.createDataFrame([(t,) for t in stamps], "time timestamp_ntz"), spans).collect()}
    assert got == {(n, t) for n, lo, hi, closed in bounds for t in stamps if (lo <= t if closed else lo < t) and t <= hi}


def test_periods_take_a_stamp_to_end_its_hour(spark):
    stamps = [datetime(y, m, 1) + timedelta(hours=h) for y in (2021, 2022) for m in range(1, 13) for h in (-1, 0, 1)]
    rows = spark.createDataFrame([(t,) for t in stamps], "time timestamp_ntz")
    for t, r in zip(stamps, rows.select(*(P.period(F.col("time"), x) for x in "MQHY")).collect()):
        at = t - timedelta(seconds=1)
        assert tuple(r) == (f"{at:%Y-%m}", f"{at.year}Q{(at.month + 2) // 3}", f"{at.year}H{1 + at.month // 7}", str(at.year))


# quantiles, shares, bins ----------------------------------------------------------------------


def hidden_quantile(values, p):
    """Linear interpolation with hidden values at 1; None where one of the neighbours is hidden."""
    rows = sorted((1.0, True) if v is None else (v, False) for v in values)
    h = (len(rows) - 1) * p
    lo, hi = rows[math.floor(h + 1e-12)], rows[math.ceil(h - 1e-12)]
    return None if lo[1] or hi[1] else lo[0] + (hi[0] - lo[0]) * (h - math.floor(h + 1e-12))


def test_quantiles_around_hidden_values(spark):
    g = np.random.default_rng(2)
    groups = {k: [None if -4 <= v <= 6 else float(v) for v in np.round(g.normal(0, 7, int(n)), 1)] for k, n in enumerate(g.integers(1, 40, 12))}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    probs = (0.1, 0.25, 0.5, 0.75, 0.9)
    got = {(r.k, r.p): r.q for r in C.censored_quantiles(rows, ["k"], "v", probs).collect()}
    for k, vs in groups.items():
        for p in probs:
            want = hidden_quantile(vs, p)
            assert got[k, p] is None if want is None else got[k, p] == pytest.approx(want)


def test_shares_by_phase(spark):
    g = np.random.default_rng(3)
    rows = [(int(h), bool(f)) for h, f in zip(g.integers(0, 500, 700), g.integers(0, 2, 700))]
    got = {r.phase: r for r in C.phase_shares(keyed(spark, rows, "h int, f boolean"), ["k"], F.col("f"), F.col("h") % 8).collect()}
    want = {p: statistics.mean(f for h, f in rows if h % 8 == p) for p in range(8)}
    assert {p: r.share for p, r in got.items()} == pytest.approx(want)
    assert {(r.smallest, r.largest) for r in got.values()} == {(min(want.values()), max(want.values()))}


def test_bins_are_closed_on_the_right_and_kept_when_empty(spark):
    g = np.random.default_rng(4)
    rows = [(float(x), float(y)) for x, y in zip(g.integers(-3, 4, 90), g.normal(size=90))]
    edges = (-2.0, 0.0, 1.0, 50.0)
    got = G.binned(keyed(spark, rows, "x double, y double"), ["k"], "y", "x", edges).orderBy("bin").collect()
    limits = [-math.inf, *edges, math.inf]
    for r, lo, hi in zip(got, limits[:-1], limits[1:], strict=True):
        own = [y for x, y in rows if lo < x <= hi]
        assert (r.n, r.lo, r.hi) == (len(own), lo, hi) and (not own or r.q50 == pytest.approx(float(np.median(own))))


def test_chi_square_tail_adds_up_to_its_density(spark):
    xs = np.linspace(0.5, 40, 12)
    for df in (2, 6, 12, 24):
        got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(T.chi2_sf(F.col("x"), F.lit(df))).collect()]
        grid = np.linspace(0, 40, 400_001)
        with np.errstate(divide="ignore"):
            density = np.exp((df / 2 - 1) * np.log(np.maximum(grid, 1e-300)) - grid / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
        below = np.cumsum((density[1:] + density[:-1]) / 2) * 1e-4
        assert got == pytest.approx([1 - below[int(round(x / 1e-4)) - 1] for x in xs], abs=1e-5)


# blocks and hours ----------------------------------------------------------------------------


def test_eight_hour_blocks_of_both_stamps(spark):
    g = np.random.default_rng(5)
    keep = [t for t in hours(24 * 6) if g.random() < 0.97]
    value = {t: float(g.integers(-9, 10)) for t in keep}
    for closes in (True, False):
        want = {}
        for day in range(7):
            for b in (0, 8, 16):
                begin = START + timedelta(days=day, hours=b)
                own = [begin + timedelta(hours=i + closes) for i in range(8)]
                if all(t in value for t in own):
                    want[begin + timedelta(hours=8)] = statistics.mean(value[t] for t in own)
        got = S.block_means(keyed(spark, list(value.items()), "time timestamp_ntz, v double"), ["k"], "v", closes, True).collect()
        assert {r.block: r["mean"] for r in got} == pytest.approx(want)


def test_hours_of_minutes(spark):
    g = np.random.default_rng(6)
    minutes = [(START + timedelta(minutes=i), float(g.normal())) for i in range(60 * 10) if g.random() < 0.98]
    got = {r.hour: r for r in S.hourly_from_minutes(keyed(spark, minutes, "time timestamp_ntz, v double"), ["k"], "v").collect()}
    by = {}
    for t, v in minutes:
        by.setdefault(t.replace(minute=0), {})[t.minute] = v
    for begin, own in by.items():
        h = begin + timedelta(hours=1)  # hours are stamped when they end
        assert got[h].n == len(own) and got[h]["mean"] == pytest.approx(statistics.mean(own.values()))
        assert got[h].close == own.get(59)


def test_linear_weights_over_hours_are_those_over_minutes(spark):
    v = np.random.default_rng(7).normal(size=960)
    rows = keyed(spark, [(datetime(2023, 3, 7) + timedelta(minutes=i), float(x)) for i, x in enumerate(v)], "time timestamp_ntz, v double")
    got = S.linear_eight_hours(S.hourly_from_minutes(rows, ["k"], "v"), ["k"]).orderBy("block").collect()
    weight = np.arange(1, 481)
    assert [r.value for r in got] == pytest.approx([float((v[i : i + 480] * weight).sum() / weight.sum()) for i in (0, 480)])


def test_order_of_a_mean_and_a_premium_that_may_be_hidden(spark):
    g = np.random.default_rng(8)
    own = [float(x) for x in np.round(g.uniform(-9, 11, 80), 1)]
    other = [None if g.random() < 0.5 else float(x) for x in np.round(g.choice([-8, -5.5, 7, 9.5], 80) + g.normal(0, 1, 80), 1)]
    blocks = spark.createDataFrame(list(enumerate(own)), "block int, own_bps double")
    settle = spark.createDataFrame(list(enumerate(other)), "block int, other_bps double")
    got = {r.block: r.order for r in G.block_order(settle, blocks, []).collect()}
    # where the premium is hidden it may be anything from -4 to 6
    for i, (a, b) in enumerate(zip(own, other)):
        reach = (-4, 6) if b is None else (b, b)
        assert got[i] == ("above" if a > reach[1] else "below" if a < reach[0] else "undecided")
    s = G.order_summary(G.block_order(settle, blocks, []).withColumn("k", F.lit(1)), ["k"]).first()
    n = len(own)
    assert s.lower == pytest.approx(sum(v == "above" for v in got.values()) / n) and s.upper == pytest.approx(1 - sum(v == "below" for v in got.values()) / n)


# eras of a rule ------------------------------------------------------------------------------


def funding_records(spark, plan):
    """Records one to eight hours apart: (hours since the one before, clamp in bps or None, premium in bps)."""
    at, out = START, []
    for gap, clamp, p in plan:
        at += timedelta(hours=gap)
        p = Decimal(str(p)) / 10_000
        c = None if clamp is None else Decimal(clamp) / 10_000
        f = p if c is None else p + max(min(Decimal("0.0001") - p, c), -c)
        out.append((at, f if gap >= 4 else f / 8, p))
    return keyed(spark, out, "time timestamp_ntz, rate decimal(20,12), premium decimal(20,12)")


def test_eras_are_the_stretches_of_the_plan(spark):
    g = np.random.default_rng(9)
    stretches = [(8, 3), (1, 3), (1, 5), (1, None), (1, 5)]
    sizes = [int(x) for x in g.integers(5, 15, len(stretches))]
    # premiums far from the floor show the rule in every record
    plan = [(gap, clamp, float(g.choice([-11.5, 13.0, 17.5]))) for (gap, clamp), n in zip(stretches, sizes) for _ in range(n)]
    got = I.eras(I.rule_records(funding_records(spark, plan), ["k"]), ["k"]).orderBy("first_time").collect()
    assert [r.n_records for r in got] == sizes
    assert [(r.schedule, r.rule) for r in got] == [(f"{gap}h", "unclamped" if c is None else f"clamp_{c}bp") for gap, c in stretches]


def test_records_at_the_floor_stay_with_the_era_before(spark):
    for quiet in (1, 2, 6):
        plan = [(1, 3, 14.0)] * 5 + [(1, 5, 0.5)] * quiet + [(1, 5, 15.0)] * 7
        got = I.eras(I.rule_records(funding_records(spark, plan), ["k"]), ["k"]).orderBy("first_time").collect()
        assert [(r.n_records, r.undetermined_after) for r in got] == [(5 + quiet, quiet), (7, 0)]


# daily series --------------------------------------------------------------------------------


def negative_stretches(values):
    out, run = [], []
    for i, v in enumerate([*values, None]):
        if v is not None and v < 0:
            run.append(i)
        elif run:
            out.append((run[0], run[-1]))
            run = []
    return out


def test_negative_spells_and_the_longest(spark):
    g = np.random.default_rng(10)
    for _ in range(4):
        values = [None if g.random() < 0.1 else float(v) for v in g.normal(0.1, 1, 60)]
        rows, days = daily(spark, values)
        want = negative_stretches(values)
        got = {(r.first_day, r.last_day, r.length) for r in I.negative_spells(rows, ["k"], "v").collect()}
        assert got == {(days[a], days[b], b - a + 1) for a, b in want}
        top = I.longest_negative_run(rows, ["k"], "v").first()
        a, b = max(want, key=lambda s: (s[1] - s[0], -s[0]))
        assert (top.first_day, top.last_day, top.n_negative) == (days[a], days[b], sum(v is not None and v < 0 for v in values))


def test_rolling_means_need_all_days(spark):
    g = np.random.default_rng(11)
    values = [None if g.random() < 0.05 else float(v) for v in g.integers(-5, 6, 90)]
    rows, days = daily(spark, values)
    full = {i: statistics.mean(values[i - 4 : i + 1]) for i in range(4, 90) if None not in values[i - 4 : i + 1]}
    got = I.rolling_stats(rows, ["k"], "v", 5).first()
    low = min(full, key=lambda i: (full[i], i))
    assert (got.windows, got.negative, got.lowest_day) == (len(full), sum(v < 0 for v in full.values()), days[low]) and got.lowest == pytest.approx(full[low])


def test_autocorrelations_use_calendar_days(spark):
    g = np.random.default_rng(12)
    values = [None if g.random() < 0.1 else float(v) for v in np.cumsum(g.normal(size=150))]
    rows, _ = daily(spark, values)
    mean = statistics.mean(v for v in values if v is not None)
    dev = [None if v is None else v - mean for v in values]
    total = sum(v * v for v in dev if v is not None)
    got = {r.lag: r.acf for r in I.autocorrelations(rows, ["k"], "v", (1, 3, 10)).collect()}
    for lag in (1, 3, 10):
        assert got[lag] == pytest.approx(sum(a * b for a, b in zip(dev, dev[lag:]) if a is not None and b is not None) / total)


def test_level_shift_against_all_placements(spark):
    g = np.random.default_rng(13)
    values = [float(v) for v in g.normal(size=25)] + [float(v) for v in g.normal(1.5, 1, 25)]
    rows, days = daily(spark, values)
    mean = lambda a: statistics.mean(values[a : a + 4])
    shifts = {b: mean(b + 2) - mean(b - 3) for b in range(3, len(values) - 5)}  # b: last day before, one day left out
    got = I.level_shift(rows, ["k"], "v", str(days[24]), str(days[26]), 4).first()
    assert got["shift"] == pytest.approx(shifts[24]) and got.placements == len(shifts)
    assert got.share_as_large == pytest.approx(sum(abs(v) >= abs(shifts[24]) - 1e-12 for v in shifts.values()) / len(shifts))


# variants of series --------------------------------------------------------------------------


def test_variants_of_the_upper_tail(spark):
    g = np.random.default_rng(14)
    stamps, values = hours(300), [float(v) for v in np.round(g.normal(0, 3, 300), 2)]
    rows = keyed(spark, list(zip(stamps, values)), "time timestamp_ntz, v double")
    cap, top = float(np.quantile(values, 0.99)), int(np.argmax(values))
    second = sorted(values)[-2]
    want = {"baseline": values, "max_to_second": [second if i == top else v for i, v in enumerate(values)], "drop_max": [v for i, v in enumerate(values) if i != top], "cap_q99": [min(v, cap) for v in values]}
    got = {}
    for r in T.sensitivity_variants(rows, ["k"], "v", "time").orderBy("time").collect():
        got.setdefault(r.variant, []).append(r.v)
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    lo, hi = stamps[100], stamps[200]
    got = {}
    for r in T.upper_tail_variants(rows, ["k"], "v", "time", str(lo), str(hi)).orderBy("time").collect():
        got.setdefault(r.variant, []).append(r.v)
    assert got["tail_capped_within"] == pytest.approx([min(v, cap) if lo <= t < hi else v for t, v in zip(stamps, values)])
    assert got["capped_from"] == pytest.approx([min(v, cap) for t, v in zip(stamps, values) if t >= hi])


def test_winsorised_values_lie_between_the_quantiles(spark):
    values = [float(v) for v in np.random.default_rng(15).normal(size=400)]
    got = sorted(r.capped for r in T.winsorised(keyed(spark, [(v,) for v in values], "v double"), ["k"], "v", 0.05).collect())
    assert got == pytest.approx(sorted(np.clip(values, np.quantile(values, 0.05), np.quantile(values, 0.95))))


def test_battery_has_a_row_per_test(spark):
    z = np.random.default_rng(16).normal(size=300)
    rows = keyed(spark, [(i, float(v)) for i, v in enumerate(z)], "t int, z double")
    got = {(r.test, r.lag): r for r in T.residual_battery(rows, ["k"], "z", "t").collect()}
    assert len(got) == 4 * 2 + 3
    dev = np.abs(z) - np.abs(z).mean()
    rho = [float((dev[k:] * dev[:-k]).sum() / (dev**2).sum()) for k in range(1, 11)]
    assert got["ljung_box_sizes", 10].statistic == pytest.approx(300 * 302 * sum(r * r / (300 - k) for k, r in enumerate(rho, 1)))
    assert all(0 <= r.p <= 1 for r in got.values()) and got["arch_trimmed", 12].statistic != got["arch", 12].statistic


# decomposition, ratios -----------------------------------------------------------------------


def test_shapley_parts_add_up(spark):
    g = np.random.default_rng(17)
    cube = {c: float(g.uniform()) for c in itertools.product((0, 1), repeat=3)}
    rows = keyed(spark, [(*c, v) for c, v in cube.items()], "location int, averaging int, dispersion int, share double")
    got = {r.factor: r for r in G.shapley(rows, ["k"]).collect()}
    for i, f in enumerate(G.FACTORS):
        steps = []
        for order in itertools.permutations(range(3)):
            on = [int(order.index(j) < order.index(i)) for j in range(3)]
            before = cube[tuple(on)]
            on[i] = 1
            steps.append(cube[tuple(on)] - before)
        assert (got[f].part, got[f].lowest, got[f].highest) == pytest.approx((statistics.mean(steps), min(steps), max(steps)))
    assert sum(r.part for r in got.values()) == pytest.approx(cube[1, 1, 1] - cube[0, 0, 0])


def test_fieller_sets_hold_what_the_test_does_not_reject(spark):
    g = np.random.default_rng(18)
    rows = [tuple(map(float, (g.normal(1, 2), g.normal(0.5, 1), *g.uniform(0.01, 1, 2)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "a double, b double, va double, vb double").select(R.fieller(F.col("a"), F.col("b"), F.col("va"), F.col("vb"), F.lit(0.0)).alias("s")).select("s.*").collect()
    shapes = set()
    for (a, b, va, vb), s in zip(rows, got):
        shapes.add(s.shape)
        for ratio in (-30.0, -3.0, -0.7, 0.0, 0.4, 1.0, 2.5, 20.0):
            kept = (a - ratio * b) ** 2 <= R.Z95**2 * (va + ratio**2 * vb)
            held = {"bounded": lambda: s.lo <= ratio <= s.hi, "two_rays": lambda: ratio <= s.lo or ratio >= s.hi, "whole_line": lambda: True}[s.shape]()
            assert held == kept
    assert shapes == {"bounded", "two_rays", "whole_line"}


def test_sides_of_unity(spark):
    sets = [("bounded", 1.1, 3.0), ("bounded", 0.2, 0.9), ("bounded", 0.5, 1.5), ("bounded", -2.0, -1.0), ("two_rays", -1.0, 1.5), ("two_rays", 0.5, 1.5), ("whole_line", None, None), ("undefined", None, None)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sets], f"s {R.SET}").select(R.side_of_unity(F.col("s"))).collect()]
    assert got == ["above", "below", "ns", "undetermined", "above", "undetermined", "ns", "undetermined"]


def test_wald_side_and_sets_of_half_lives(spark):
    rows = [(0.9, 0.5, 1e-4, 1e-3, 0.0), (0.5, 0.9, 1e-3, 1e-4, 0.0), (0.8, 0.78, 1e-2, 1e-2, 1e-3), (0.9, -0.5, 1e-4, 1e-3, 1e-5)]
    cols = [F.col(c) for c in "abcde"]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").select(R.wald(*cols).alias("w"), R.ratio_sets(*cols).alias("s")).collect()
    assert [r.w.side for r in got] == ["above", "below", "ns", "above"]
    for (a, b, va, vb, cov), r in zip(rows, got):
        same = 1 if a * b > 0 else -1
        assert r.w.z == pytest.approx((abs(a) - abs(b)) / math.sqrt(va + vb - 2 * same * cov))
        assert r.s.ratio == pytest.approx(math.log(abs(b)) / math.log(abs(a)))
        f = lambda x, y: math.log(abs(y)) / math.log(abs(x))
        slope = [(f(a + 1e-6, b) - f(a - 1e-6, b)) / 2e-6, (f(a, b + 1e-6) - f(a, b - 1e-6)) / 2e-6]
        assert r.s.se == pytest.approx(math.sqrt(slope[0] ** 2 * va + slope[1] ** 2 * vb + 2 * slope[0] * slope[1] * cov), rel=1e-4)


# panels --------------------------------------------------------------------------------------


def test_panel_rows_need_their_hour_and_the_one_before(spark):
    g = np.random.default_rng(19)
    stamps = hours(80)
    close = {t: float(100 + g.normal()) for t in stamps if g.random() < 0.9}
    paid = {t: 1.0 for t in stamps if g.random() < 0.9}
    c = keyed(spark, list(close.items()), "time timestamp_ntz, close double")
    f = keyed(spark, [(t + timedelta(seconds=2), v) for t, v in paid.items()], "time timestamp_ntz, premium_bps double")
    got = {r.time: r.log_return for r in J.hourly_panel(c, f, ["k"]).collect()}
    one = timedelta(hours=1)
    assert got == pytest.approx({t: math.log(close[t] / close[t - one]) for t in stamps if t in paid and t in close and t - one in close})


def test_returns_do_not_look_ahead(spark):
    g = np.random.default_rng(20)
    closes = [float(v) for v in 50 + np.abs(g.normal(size=30))]
    returns = lambda v: {r.time: r.log_return for r in J.log_returns(keyed(spark, list(zip(hours(30), v)), "time timestamp_ntz, close double"), ["k"], "close").collect()}
    whole = returns(closes)
    for cut in (5, 17):
        changed = returns([*closes[:cut], *(9 * v for v in closes[cut:])])
        assert all(changed[t] == whole[t] for t in hours(cut) if t in whole)


def test_rebuilt_hours_end_on_the_bar_and_keep_the_shape(spark):
    coarse = keyed(spark, [(START, 80.0, 96.0)], "time timestamp_ntz, open double, close double")
    moves = [0.03, -0.01]
    proxy = keyed(spark, list(zip(hours(2), moves)), "time timestamp_ntz, log_return double")
    got = J.reconstruct_hourly(coarse, proxy, ["k"]).orderBy("time").collect()
    left = (math.log(96 / 80) - sum(moves)) / 2
    assert got[-1].close == pytest.approx(96.0) and math.log(got[0].close / 80) == pytest.approx(moves[0] + left)


# long series in pieces -----------------------------------------------------------------------


def test_hac_slope_in_pieces(spark):
    g = np.random.default_rng(21)
    x = np.cumsum(g.normal(size=130))
    y = 0.4 * x + g.normal(size=130)
    rows = keyed(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "t int, x double, y double")
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    s = (y - y.mean() - slope * (x - x.mean())) * (x - x.mean())
    meat = (s * s).sum() + 2 * sum((1 - k / 6) * (s[k:] * s[:-k]).sum() for k in range(1, 6))
    for piece in (7, 40, 1000):
        got = T.hac_slope(rows, ["k"], "y", "x", "t", 5, piece).first()
        assert (got.n, got.slope) == (130, pytest.approx(slope)) and got.se == pytest.approx(math.sqrt(meat) / ((x - x.mean()) ** 2).sum())


def test_drawdowns_over_days(spark):
    g = np.random.default_rng(22)
    stamps, price = hours(200), 100 + np.cumsum(g.normal(size=200))
    rows = keyed(spark, [(t, float(p)) for t, p in zip(stamps, price)], "time timestamp_ntz, close double")
    lo, hi = stamps[60], stamps[150]
    got = G.drawdown_context(rows, ["k"], F.lit(lo), F.lit(hi)).first()
    down = price / np.maximum.accumulate(price) - 1
    assert got.n == 91 and got.mean_drawdown == pytest.approx(down[60:151].mean()) and got.mean_price == pytest.approx(price[60:151].mean())


def test_numbers_run_over_stretches(spark):
    rows = spark.createDataFrame([(k, 40_000 * i) for k in ("a", None) for i in range(9)], "k string, t int")
    got = T.numbered(rows, ["k"], "t").orderBy("k", "t").collect()
    assert [r._i for r in got] == [*range(9)] * 2
