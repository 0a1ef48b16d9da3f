"""Student's t distribution, for single numbers and as expressions of columns.

The incomplete beta function is evaluated by its continued fraction (modified
Lentz), after the usual reflection for fast convergence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-30


def _fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 301):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return value


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1 - x) / b


def student_cdf(t: float, df: float) -> float:
    """For t of at least zero; a half where df isn't positive."""
    if df <= 0:
        return 0.5
    return 1 - 0.5 * incomplete_beta(df / (df + t * t), df / 2, 0.5)


def two_sided_p(t: float, df: float) -> float:
    return min(1.0, max(0.0, 2 * (1 - student_cdf(abs(t), df))))


def student_quantile(p: float, df: float) -> float:
    """By bisection, for p above a half."""
    low, high = -400.0, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _signed_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _signed_cdf(t: float, df: float) -> float:
    return student_cdf(t, df) if t >= 0 else 1 - student_cdf(-t, df)


# Lanczos' coefficients of the log-gamma function for g = 7 and nine terms.
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_STEPS = 300


def log_gamma(x: Column) -> Column:
    """For x above zero, by the series at x + 1."""
    series = sum((c / (x + k) for k, c in enumerate(_LANCZOS[1:], 1)), F.lit(_LANCZOS[0]))
    t = x + _LANCZOS_G + 0.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.ln(t) - t + F.ln(series) - F.ln(x)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _fraction_column(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction as a fold over its steps, which are passed over once it has settled."""
    away = lambda v: let(v, lambda w: F.when(F.abs(w) > _TINY, w).otherwise(F.lit(_TINY)))
    names = ("a", "b", "x", "c", "d", "v", "done")
    state = lambda *values: F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])
    start = let(1 / away(1 - (a + b) * x / (a + 1)), lambda d: state(a, b, x, F.lit(1.0), d, d, F.lit(False)))

    def top(s: Column, m: Column, even: Column) -> Column:
        """Even and odd steps of one sequence."""
        return F.when(even, -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))).otherwise(m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m)))

    def moved(s: Column, t: Column, even: Column) -> Column:
        cd = let(F.struct(away(1 + t / s["c"]).alias("c"), (1 / away(1 + t * s["d"])).alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (n["c"] * n["d"]).alias("by")))
        # Only an even step may settle it.
        return let(cd, lambda n: state(s["a"], s["b"], s["x"], n["c"], n["d"], s["v"] * n["by"], (F.abs(n["by"] - 1) < 1e-12) & even))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.when(s["done"], s).otherwise(let(top(s, F.floor((i + 1) / 2).cast("double"), even), lambda t: moved(s, t, even)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * _STEPS)), start, step, lambda s: s["v"])


def incomplete_beta_column(x: Column, a: Column, b: Column) -> Column:
    """Regularised, in generated code but for its fold."""

    def inside(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x))
        # Turned round where the fraction settles sooner.
        near = x < (a + 1) / (a + b + 2)
        sides = F.struct(near.alias("near"), front.alias("front"), F.when(near, a).otherwise(b).alias("p"), F.when(near, b).otherwise(a).alias("q"), F.when(near, x).otherwise(1 - x).alias("at"))
        return let(sides, lambda t: let(t["front"] * _fraction_column(t["p"], t["q"], t["at"]) / t["p"], lambda tail: F.when(t["near"], tail).otherwise(1 - tail)))

    given = F.struct(x.alias("x"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    return let(given, lambda s: F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).otherwise(inside(s)))


def cdf_column(t: Column, df: Column) -> Column:
    """Of any t; a half where df isn't positive."""
    upper = 0.5 * incomplete_beta_column(df / (df + t * t), df / 2, F.lit(0.5))
    return F.when(df <= 0, 0.5).when(t >= 0, 1 - upper).otherwise(upper)


def t_test(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic, in generated code; null where either is."""
    t, df = t.cast("double"), df.cast("double")
    tail = incomplete_beta_column(df / (df + t * t), df / 2, F.lit(0.5))
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(t) & ~F.isnan(df), F.when(df <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))))


def quantile_column(p: Column, df: Column) -> Column:
    """By bisection as ``student_quantile``, for p above a half; one fold in another, so meant for rows of results."""
    start = F.struct(F.lit(-400.0).alias("low"), F.lit(400.0).alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        below = cdf_column(mid, df) < p
        return F.struct(F.when(below, mid).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda s: (s["low"] + s["high"]) / 2)
