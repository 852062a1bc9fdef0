"""Half-lives of AR coefficients and confidence sets of their ratio, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Z95 = 1.959963984540054
SET = "struct<shape:string,lo:double,hi:double>"


def half_life(phi: Column) -> Column:
    """ln 1/2 / ln |phi|; null where |phi| is 0 or 1."""
    a = F.abs(phi)
    return F.when((a > 0) & (a != 1), F.lit(math.log(0.5)) / F.ln(a))


def half_life_slope(phi: Column) -> Column:
    """Derivative of the half-life by phi."""
    a = F.abs(phi)
    return F.when((a > 0) & (a != 1), -F.lit(math.log(0.5)) / (phi * F.pow(F.ln(a), 2)))


def wald(calm: Column, stressed: Column, var_calm: Column, var_stressed: Column, cov: Column, z: float = Z95) -> Column:
    """struct(z, side) of the test that both half-lives are equal, that is |calm| = |stressed|, which is linear in the two: above, below, ns, or undetermined."""
    same = F.when(F.signum(F.when(calm == 0, 1.0).otherwise(calm)) == F.signum(F.when(stressed == 0, 1.0).otherwise(stressed)), 1.0).otherwise(-1.0)
    var = var_calm + var_stressed - 2 * same * cov
    score = F.when(var > 0, (F.abs(calm) - F.abs(stressed)) / F.sqrt(var))
    return F.struct(score.alias("z"), F.when(score > z, "above").when(score < -z, "below").when(score.isNotNull(), "ns").otherwise("undetermined").alias("side"))


def switching_side(wald_side: Column, persistence: Column, persistence_se: Column, calm: Column, stressed: Column, z: float = Z95) -> Column:
    """The side for half-lives under switching: that of the test where it does not reject; else only if the chain is surely persistent and both slopes positive."""
    sure = F.coalesce((persistence - z * persistence_se > 0) & (calm > 0) & (stressed > 0), F.lit(False))
    return F.when(wald_side == "ns", "ns").when(wald_side.isin("above", "below") & sure, wald_side).otherwise("undetermined")


def ratio_sets(calm: Column, stressed: Column, var_calm: Column, var_stressed: Column, cov: Column, z: float = Z95) -> Column:
    """struct(ratio, se, linear, log, fieller) of the half-lives' ratio ln|stressed| / ln|calm|: by its derivatives, those of its logarithm, and as a ratio of two normal estimates."""
    lc, ls = F.ln(F.abs(calm)), F.ln(F.abs(stressed))
    ratio, to_calm, to_stressed = ls / lc, -ls / (calm * lc * lc), 1 / (stressed * lc)
    var = to_calm**2 * var_calm + to_stressed**2 * var_stressed + 2 * to_calm * to_stressed * cov
    se = F.when(var >= 0, F.sqrt(var))
    factor = F.exp(z * se / ratio)
    bounded = lambda ok, lo, hi: F.when(ok, F.struct(F.lit("bounded").alias("shape"), lo.alias("lo"), hi.alias("hi"))).otherwise(F.lit(None).cast(SET))
    linear = bounded(se.isNotNull(), ratio - z * se, ratio + z * se)
    log = bounded(se.isNotNull() & (ratio > 0), ratio / factor, ratio * factor)
    return F.struct(ratio.alias("ratio"), se.alias("se"), linear.alias("linear"), log.alias("log"), fieller(ls, lc, var_stressed / stressed**2, var_calm / calm**2, cov / (calm * stressed), z).alias("fieller"))


def fieller(a: Column, b: Column, var_a: Column, var_b: Column, cov: Column, z: float = Z95) -> Column:
    """Confidence set of a / b as struct(shape, lo, hi): bounded, two_rays (outside lo..hi), whole_line or undefined."""
    q, m, c = b * b - z * z * var_b, a * b - z * z * cov, a * a - z * z * var_a
    root = m * m - q * c
    lo, hi = (m - F.sqrt(F.greatest(root, F.lit(0.0)))) / q, (m + F.sqrt(F.greatest(root, F.lit(0.0)))) / q
    made = lambda shape, x, y: F.struct(F.lit(shape).alias("shape"), x.cast("double").alias("lo"), y.cast("double").alias("hi"))
    none = F.lit(None)
    return F.when((q == 0) | q.isNull(), made("undefined", none, none)).when((q > 0) & (root >= 0), made("bounded", F.least(lo, hi), F.greatest(lo, hi))).when((q < 0) & (root > 0), made("two_rays", F.least(lo, hi), F.greatest(lo, hi))).when(q < 0, made("whole_line", none, none)).otherwise(made("undefined", none, none))


def side_of_unity(s: Column) -> Column:
    """Where the positive part of a confidence set lies against 1: above, below, ns (holds 1) or undetermined."""
    lo, hi = s["lo"], s["hi"]
    one_piece = F.when(hi <= 0, "undetermined").when(lo > 1, "above").when(hi < 1, "below").otherwise("ns")
    upper_ray = F.when(hi > 1, "above").otherwise("ns")
    rays = F.when(lo <= 0, upper_ray).when((lo < 1) & (hi > 1), "undetermined").otherwise("ns")
    known = lo.isNotNull() & hi.isNotNull()
    return F.when(s["shape"] == "whole_line", "ns").when(known & (s["shape"] == "bounded"), one_piece).when(known & (s["shape"] == "two_rays"), rays).otherwise("undetermined")


def positive_pieces(s: Column, lo_limit: float, hi_limit: float) -> Column:
    """The parts of a confidence set inside an axis range, as an array of struct(lo, hi)."""
    low, high = F.lit(lo_limit), F.lit(hi_limit)
    piece = lambda x, y: F.struct(x.cast("double").alias("lo"), y.cast("double").alias("hi"))
    none = F.array().cast("array<struct<lo:double,hi:double>>")
    some = lambda *p: F.filter(F.array(*p), lambda x: x["lo"] < x["hi"])
    return F.when(s["shape"] == "bounded", some(piece(F.greatest(s["lo"], low), F.least(s["hi"], high)))).when(s["shape"] == "two_rays", some(piece(low, F.least(s["lo"], high)), piece(F.greatest(s["hi"], low), high))).when(s["shape"] == "whole_line", some(piece(low, high))).otherwise(none)


def stationary2(p_stay_0: Column, p_stay_1: Column) -> Column:
    """Stationary share of state 0 of a two-state chain."""
    return (1 - p_stay_1) / (2 - p_stay_0 - p_stay_1)


def expected_duration(p_stay: Column) -> Column:
    return F.when(p_stay < 1, 1 / (1 - p_stay))


def information_criteria(loglik: Column, parameters: Column, n: Column) -> Column:
    return F.struct((2 * parameters - 2 * loglik).alias("aic"), (parameters * F.ln(n) - 2 * loglik).alias("bic"))


def free_parameters(k: Column) -> Column:
    """Of a Gaussian chain with k states: k(k-1) transitions, 2k moments, k-1 initial shares."""
    return k * k + 2 * k - 1
