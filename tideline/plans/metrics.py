"""Composite metrics: the operators put together for the panel's questions.

Columns are parameters with the day model's names as defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import scalars as S
from ..operators import breaks, density, regression, smooth, spectral, stats
from ..operators.multiplicity import benjamini_hochberg, bh_values
from ..operators.treefit import fit_models

# The pairs whose correlations are compared, against recovery where nothing else is named.
DRIVERS = {
    "sleepHours": "recovery", "sleepEfficiency": "recovery", "sleepConsistency": "recovery", "sleepDebt": "recovery", "remShare": "recovery", "deepShare": "recovery", "strainPrev": "recovery",
    "workoutMinutes": "recoveryNext", "respiratoryRate": "recovery", "skinTemp": "recovery",
}


def drivers(days: DataFrame, pairs: dict[str, str] = DRIVERS) -> DataFrame:
    return stats.correlations(days, {x: (x, y) for x, y in pairs.items()})


def impulse_response(days: DataFrame, outcome: str = "recovery", driver: str = "strain", controls: Sequence[str] = ("sleepHours",), max_lag: int = 7, min_n: int = 150, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Distributed lags with weekday and month effects, q-values over an entity's lags, and its last lag that lowers the outcome."""
    d, dow = regression.weekday_dummies(days, day)
    d, month = regression.month_dummies(d, day)
    fit = regression.distributed_lag(d, outcome, driver, max_lag, 1, [*controls, *dow, *month], L.HAC, None, day, keys, min_n, effects=[dow, month])
    tested = benjamini_hochberg(fit, "p", "lag", keys)
    bites = F.when((F.col("coef") < 0) & (F.col("q") <= 0.05), F.col("lag"))
    last = F.max(bites).over(Window.partitionBy(*keys))  # a row for each lag
    return tested.withColumn("last_lag", last).orderBy(*keys, "lag")


HABIT = "ok boolean, n long, min_n long, missing long, question string, kind string, coef double, se double, t double, p double, ci_low double, ci_high double, q double, n_yes long, n_no long"


def habit_screen(days: DataFrame, journal: DataFrame, day: str = "d", min_group: int = 8, min_coverage: float = 0.6) -> DataFrame:
    """Which questions are answered often enough both ways: ``question, n_yes, n_no, coverage, keep``."""
    answerable = days.agg(F.count(F.lit(1)).alias("__all"))
    by = journal.groupBy("question").agg(F.count(F.when(F.col("yes"), 1)).alias("n_yes"), F.count(F.when(~F.col("yes"), 1)).alias("n_no"))
    out = by.join(F.broadcast(answerable)).withColumn("coverage", (F.col("n_yes") + F.col("n_no")) / F.col("__all")).drop("__all")  # one row
    return out.withColumn("keep", (F.col("n_yes") >= min_group) & (F.col("n_no") >= min_group) & (F.col("coverage") >= min_coverage))


def adjusted_habits(
    days: DataFrame, journal: DataFrame, target: str = "recovery", controls: Sequence[str] = ("sleepHours", "strainPrev", "bedtimeHours"), min_n: int = 150, min_group: int = 8,
    min_coverage: float = 0.6, day: str = "day",
) -> DataFrame:
    """All habits in one regression beside the controls, q-values over the habits: rows of ``HABIT``."""
    screen = habit_screen(days, journal, day, min_group, min_coverage).where("keep").orderBy("question").collect()  # a row for each question
    counts = {r["question"]: (r["n_yes"], r["n_no"]) for r in screen}
    wide = journal.where(F.col("question").isin(list(counts))).groupBy(day).pivot("question", list(counts)).agg(F.max(F.col("yes").cast("double"))) if counts else None
    names = {q: f"habit_{i}" for i, q in enumerate(counts)}
    d = days
    if wide is not None:
        d = days.join(wide.select(day, *[F.col(f"`{q}`").alias(n) for q, n in names.items()]), day, "left")
    d, dow = regression.weekday_dummies(d, day)
    d, month = regression.month_dummies(d, day)
    columns = [*names.values(), *controls, *dow, *month]
    back = {n: q for q, n in names.items()}

    def make(fit: L.Fit) -> pd.DataFrame:
        base = {"ok": fit.ok, "n": fit.n, "min_n": fit.min_n, "missing": fit.missing}
        habits = sorted((t for t in fit.terms if t["term"] in back), key=lambda t: -abs(t["coef"]))
        rest = [t for t in fit.terms if t["term"] in controls]
        rows = []
        for kind, terms in (("habit", habits), ("control", rest)):
            for t, q in zip(terms, bh_values([t["p"] for t in terms]), strict=True):
                name = back.get(t["term"], t["term"])
                yes, no = counts.get(name, (None, None))
                rows.append(base | {"question": name, "kind": kind, "q": q, "n_yes": yes, "n_no": no} | {c: t[c] for c in ("coef", "se", "t", "p", "ci_low", "ci_high")})
        return pd.DataFrame(rows or [base], columns=[c.split(" ")[0] for c in HABIT.split(", ")])

    return fit_models(d, (), target, columns, make, HABIT, L.HAC, None, day, True, min_n, effects=[dow, month])


def elasticities(days: DataFrame, target: str = "recovery", sleep: str = "sleepHours", strain: str = "strainPrev", more: Sequence[str] = ("bedtimeHours",), min_n: int = 150, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """The controls' coefficients with q-values, and how much sleep offsets a unit of strain."""
    d, dow = regression.weekday_dummies(days, day)
    d, month = regression.month_dummies(d, day)
    shown = [sleep, strain, *more]
    columns = [*shown, *dow, *month]
    schema = "ok boolean, n long, term string, coef double, se double, p double, ci_low double, ci_high double, q double, reason string"

    def make(fit: L.Fit) -> pd.DataFrame:
        terms = [t for t in fit.terms if t["term"] in shown]
        rows = [{"ok": True, "n": fit.n, "q": q, "reason": None} | {c: t[c] for c in ("term", "coef", "se", "p", "ci_low", "ci_high")} for t, q in zip(terms, bh_values([t["p"] for t in terms]), strict=True)]
        if fit.ok:
            rows.append({"n": fit.n, "q": None} | L.ratio(fit, strain, sleep, negate=True) | {"term": "substitution"})
        return pd.DataFrame(rows or [{"ok": False, "n": fit.n}], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return fit_models(d, keys, target, columns, make, schema, L.HAC, None, day, True, min_n, effects=[dow, month])


def dose_response(days: DataFrame, x: str, y: str, min_n: int = 60, day: str = "d") -> DataFrame:
    """Binned means, where there are enough complete pairs."""
    n = days.agg(F.count(F.when(S.is_num(F.col(x)) & S.is_num(F.col(y)), 1)).alias("__n"))
    return smooth.binscatter(days, x, y, order=day).join(F.broadcast(n)).where(F.col("__n") >= min_n).drop("__n")  # one row


def dose_points(days: DataFrame, x: str, y: str, min_n: int = 60, day: str = "d", least_share: float = 0.1) -> DataFrame:
    """The complete pairs of dose and response, and the stretches of doses without any: ``ok, n, min_n, missing, kind, x, x_high, y, share``.

    Rows of ``kind`` point have ``x, y``; those of kind gap run from ``x`` to
    ``x_high`` and have their share of the range.  Too few pairs are one row that
    says how many are missing.
    """
    a, b = S.finite(F.col(x)), S.finite(F.col(y))
    pairs = days.where(a.isNotNull() & b.isNotNull()).select(a.alias("x"), b.alias("y"))
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    head = n.select((F.col("n") >= min_n).alias("ok"), "n", F.lit(min_n).cast("long").alias("min_n"), F.greatest(F.lit(0), min_n - F.col("n")).cast("long").alias("missing"))
    none = F.lit(None).cast("double")
    points = pairs.select(F.lit("point").alias("kind"), "x", none.alias("x_high"), "y", none.alias("share"))
    gaps = density.support_gaps(pairs, "x", least_share).select(F.lit("gap").alias("kind"), F.col("lo").alias("x"), F.col("hi").alias("x_high"), none.alias("y"), "share")
    shown = points.unionByName(gaps).join(F.broadcast(head.where("ok")))  # one row
    few = head.where("NOT ok").select("*", F.lit(None).cast("string").alias("kind"), none.alias("x"), none.alias("x_high"), none.alias("y"), none.alias("share"))
    return few.unionByName(shown)


def strain_distribution(days: DataFrame, x: str = "strain", min_n: int = 30, modality_min_n: int = 60, day: str = "day") -> DataFrame:
    """Histogram bins beside the mean and the modality test, which may lack days of its own."""
    s = days.agg(F.count(S.finite(F.col(x))).alias("n_all"), F.avg(S.finite(F.col(x))).alias("mean")).where(F.col("n_all") >= min_n)
    test = density.modality(days, x, modality_min_n, day=day).select(F.col("ok").alias("modality_ok"), "modes", "p")
    return density.histogram(days, x).join(F.broadcast(s)).join(F.broadcast(test))  # one row each


def regime_breaks(days: DataFrame, x: str = "hrv28", min_n: int = 90, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    return breaks.change_points(days, x, day, 28, 4, min_n, keys)


def control_chart(days: DataFrame, x: str = "rhr", min_n: int = 45, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    return breaks.cusum(days, x, day, 0.5, 5.0, None, min_n, keys)


def rhythms(days: DataFrame, series: Sequence[str] = ("recovery", "hrv"), min_n: int = 60, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Each series's strongest period, its false-alarm probability with a q-value over the entity's series, and whether the week stands out."""
    own = [*keys, "series"]
    spectrum = spectral.lomb_scargle(spectral.unpivot_series(days, series, day, keys), "t", "v", min_n=min_n, keys=own)
    peaks = spectral.spectral_peaks(spectrum, own)
    return benjamini_hochberg(peaks, "fap", "series", keys).select(*own, "period", "power", "fap", "q", "weekly")


def heart_variation(days: DataFrame, x: str = "hrv", keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Coefficient of variation over four weeks, in percent."""
    from ..operators.days import rolling_mean, rolling_sd

    v = F.col(x)
    return days.select(*keys, day, (F.try_divide(rolling_sd(v, 28, keys, day), rolling_mean(v, 28, keys, day)) * 100).alias("cv"))


def illness_index(days: DataFrame, up: Sequence[str] = ("rhr", "respiratoryRate", "skinTemp"), down: Sequence[str] = ("hrv",), limit: float = 1.5, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Mean of four-week z-scores, those that fall with illness turned round."""
    from ..operators.days import rolling_z

    parts = [rolling_z(F.col(c), 28, keys, day) for c in up] + [-rolling_z(F.col(c), 28, keys, day) for c in down]
    index = sum(parts[1:], parts[0]) / len(parts)
    return days.select(*keys, day, index.alias("index")).withColumn("flag", F.col("index") > limit)


def streaks(days: DataFrame, x: str, at_least: float, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive days at or above a level: ``first, last, length``."""
    hit = days.where(S.finite(F.col(x)) >= at_least).select(*keys, day)
    run = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return hit.withColumn("__g", run).groupBy(*keys, "__g").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("length")).drop("__g")


def monotony(days: DataFrame, x: str = "strain", day: str = "day") -> DataFrame:
    """A week's mean load over its deviation, and that times its sum."""
    by = days.groupBy(S.iso_week(F.col(day)).alias("week")).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.sum(x).alias("total"))
    return by.select("week", F.try_divide("m", F.nullif("s", F.lit(0.0))).alias("monotony")).join(by.select("week", "total"), "week").select("week", "monotony", (F.col("monotony") * F.col("total")).alias("load"))
