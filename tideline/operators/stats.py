"""Descriptive and bivariate statistics over the day panel: one aggregation each, missing values dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

NONE: Sequence[str] = ()
finite = S.finite


def describe(df: DataFrame, x: str, keys: Sequence[str] = NONE) -> DataFrame:
    """``n, mean, sd, median`` of the finite values; sample deviation."""
    v = finite(F.col(x))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.percentile(v, 0.5).alias("median"))


def quantiles(df: DataFrame, x: str, at: Sequence[float], keys: Sequence[str] = NONE) -> DataFrame:
    """Exact quantiles with linear interpolation, ``q, value``."""
    v = finite(F.col(x))
    held = df.groupBy(*keys).agg(F.percentile(v, [float(a) for a in at]).alias("v"))
    return held.select(*keys, F.posexplode("v").alias("i", "value")).select(*keys, F.element_at(F.array(*[F.lit(float(a)) for a in at]), F.col("i") + 1).alias("q"), "value")


def _pair(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = S.is_num(x) & S.is_num(y)
    return F.when(both, x.cast("double")), F.when(both, y.cast("double"))


def pearson_agg(x: str | Column, y: str | Column, min_n: int = 8) -> list[Column]:
    """Aggregates ``r`` (null below ``min_n`` pairs or without variance) and ``n`` of complete pairs."""
    a, b = _pair(x, y)
    n = F.count(a)
    # ``corr`` divides by zero where a column is constant.
    r = F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    return [F.when(n >= min_n, r).alias("r"), n.alias("n")]


def pearson(df: DataFrame, x: str, y: str, min_n: int = 8, keys: Sequence[str] = NONE) -> DataFrame:
    return df.groupBy(*keys).agg(*pearson_agg(x, y, min_n))


def t_of_r(r: Column, n: Column) -> Column:
    return F.abs(r) * F.sqrt((n - 2) / F.greatest(F.lit(1e-12), 1 - r * r))


def linreg(df: DataFrame, x: str, y: str, keys: Sequence[str] = NONE) -> DataFrame:
    """``slope, intercept`` of complete pairs, null below three or without variance of x."""
    a, b = _pair(x, y)
    enough = (F.count(a) >= 3) & (F.coalesce(F.stddev_samp(a), F.lit(0.0)) > 0)
    return df.groupBy(*keys).agg(F.when(enough, F.regr_slope(b, a)).alias("slope"), F.when(enough, F.regr_intercept(b, a)).alias("intercept"))


def welch_aggs(value: Column, group: Column) -> list[Column]:
    """Means, counts and Welch's t of the rows where ``group`` is true against those where it is false."""
    a, b = finite(F.when(group, value)), finite(F.when(~group, value))
    se = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    t = F.when((F.count(a) >= 2) & (F.count(b) >= 2) & (se > 0), (F.avg(a) - F.avg(b)) / se)
    return [F.avg(a).alias("mean_yes"), F.avg(b).alias("mean_no"), (F.avg(a) - F.avg(b)).alias("delta"), t.alias("t"), F.count(a).alias("n_yes"), F.count(b).alias("n_no")]


def welch_t(df: DataFrame, value: str, group: str, keys: Sequence[str] = NONE) -> DataFrame:
    return df.groupBy(*keys).agg(*welch_aggs(F.col(value), F.col(group)))


def period_value(windowed: DataFrame, x: str, keys: Sequence[str] = NONE) -> DataFrame:
    """The current window's mean and its difference from the previous one's."""
    v = finite(F.col(x))
    now, before = F.avg(F.when(F.col("period") == "current", v)), F.avg(F.when(F.col("period") == "previous", v))
    return windowed.groupBy(*keys).agg(now.alias("value"), (now - before).alias("delta"))


def correlations(df: DataFrame, pairs: dict[str, tuple[str, str]], min_n: int = 8) -> DataFrame:
    """``metric, r, n`` for each named pair in one pass, without the undefined, the strongest first."""
    structs = []
    for name, (x, y) in pairs.items():
        r, n = pearson_agg(x, y, min_n)
        structs.append(F.struct(F.lit(name).alias("metric"), r, n))
    out = df.agg(F.array(*structs).alias("all")).select(F.explode("all").alias("one")).select("one.*")
    return out.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "metric")


def habit_effects(days: DataFrame, journal: DataFrame, target: str, day: str = "d", min_group: int = 8) -> DataFrame:
    """For each question, the target on days answered yes against no; both groups large enough, largest difference first."""
    joined = journal.join(days.select(day, target), day)
    out = joined.groupBy("question").agg(*welch_aggs(F.col(target), F.col("yes")))
    return out.where((F.col("n_yes") >= min_group) & (F.col("n_no") >= min_group)).orderBy(F.abs("delta").desc(), "question")


def activity_summary(sessions: DataFrame, activity: str = "activity", minutes: str = "minutes", strain: str = "strain", rate: str = "avgHr", calories: str = "calories") -> DataFrame:
    """Sessions, minutes and energy of each activity, and its mean strain and heart rate over the sessions that have them."""
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return sessions.groupBy(activity).agg(
        F.count(F.lit(1)).alias("sessions"), total(minutes).alias("minutes"), F.avg(finite(F.col(strain))).alias("mean_strain"), F.avg(finite(F.col(rate))).alias("mean_rate"),
        total(calories).alias("calories"),
    ).orderBy(F.desc("minutes"), activity)


def zone_minutes(sessions: DataFrame, zones: str = "zones", duration: str = "duration") -> DataFrame:
    """Minutes in each zone: its percentage of each session's duration."""
    parts = sessions.select(F.posexplode(zones).alias("z", "share"), F.col(duration).alias("of"))
    return parts.groupBy((F.col("z") + 1).cast("long").alias("zone")).agg(F.sum(F.col("share") / 100 * F.col("of")).alias("minutes"))


def weekday_deviation(days: DataFrame, x: str, day: str = "d") -> DataFrame:
    """Each weekday's mean and its distance from the overall mean, Monday first, empty weekdays left out."""
    v = finite(F.col(x))
    overall = days.agg(F.avg(v).alias("__all"))
    by = days.groupBy(S.weekday(F.col(day)).cast("long").alias("weekday")).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
    out = by.where("n > 0").join(F.broadcast(overall))  # one row
    return out.select("weekday", "mean", (F.col("mean") - F.col("__all")).alias("deviation"), "n").orderBy((F.col("weekday") + 6) % 7)


def describe_fields(days: DataFrame, scales: dict[str, float]) -> DataFrame:
    """``id, n, missing, mean, sd`` of several fields in display units, in one pass."""
    one = []
    for name, scale in scales.items():
        v = finite(F.col(name)) * scale
        one.append(F.struct(F.lit(name).alias("id"), F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")))
    return days.agg(F.array(*one).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def binding_field(days: DataFrame, fields: Sequence[str], min_n: int) -> DataFrame:
    """The field whose removal gains most complete rows: ``id, without_n, current_n, decisive``; no row below two fields or without a gain."""
    have = {f: S.is_num(F.col(f)) for f in fields}
    every = lambda left_out: F.count(F.when(_all([c for f, c in have.items() if f != left_out]), 1))
    rows = [F.struct(F.lit(i).alias("i"), F.lit(f).alias("id"), every(f).alias("without_n"), every(None).alias("current_n")) for i, f in enumerate(fields)]
    if len(fields) < 2:
        rows = []
    long = days.agg(F.array(*rows).alias("all") if rows else F.array().cast("array<struct<i:int,id:string,without_n:bigint,current_n:bigint>>").alias("all"))
    best = long.select(F.explode("all").alias("one")).select("one.*").where("without_n > current_n").orderBy(F.desc("without_n"), "i").limit(1)
    return best.select("id", "without_n", "current_n", (F.col("without_n") >= min_n).alias("decisive"))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def switch_on(cases: DataFrame) -> DataFrame:
    """When a panel has enough days: ``kind`` range, window or date (then with the day), from ``missing, min_n, size, total, today``."""
    kind = F.when((F.col("size") != 0) & (F.col("size") < F.col("min_n")), "range").when(F.col("total") >= F.col("size"), "window").otherwise("date")
    return cases.select("*", kind.alias("kind"), F.when(kind == "date", F.date_add("today", F.col("missing").cast("int"))).alias("d"))


def best_worst(days: DataFrame, x: str, day: str = "d", more_than: int = 6) -> DataFrame:
    """The first day of the largest and of the smallest value, where there are enough values."""
    v = finite(F.col(x))
    early = -F.datediff(F.col(day), F.lit("1970-01-01"))
    one = days.agg(
        F.count(v).alias("n"), F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), early.alias("o"), F.col(day).alias("d")))).alias("hi"),
        F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), (-early).alias("o"), F.col(day).alias("d")))).alias("lo"),
    ).where(F.col("n") > more_than)
    pick = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(f"{c}.d").alias(day), F.col(f"{c}.v").alias(x))
    return one.select(F.explode(F.array(pick("best", "hi"), pick("worst", "lo"))).alias("one")).select("one.*")


def band_share(days: DataFrame, x: str, low: float = 34, high: float = 67) -> DataFrame:
    v = finite(F.col(x))
    return days.agg((F.avg(F.when(v.isNotNull(), (v >= high).cast("double"))) * 100).alias("high_share"), (F.avg(F.when(v.isNotNull(), (v < low).cast("double"))) * 100).alias("low_share"))


def best_worst_weekday(days: DataFrame, x: str, day: str = "d") -> DataFrame:
    """Weekdays of the highest and lowest mean, where all seven are there."""
    by = weekday_deviation(days, x, day)
    return by.agg(F.count(F.lit(1)).alias("n"), F.max_by("weekday", F.struct("mean", -F.col("weekday"))).alias("best"), F.min_by("weekday", F.struct("mean", "weekday")).alias("worst")).where("n = 7").select("best", "worst")


def slope_from_r(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation times the ratio of each column's own deviation; a missing or zero deviation of x counts as one."""
    r, n = pearson_agg(x, y)
    sx = F.stddev_samp(finite(F.col(x)))
    return df.agg((r * F.stddev_samp(finite(F.col(y))) / F.coalesce(F.nullif(sx, F.lit(0.0)), F.lit(1.0))).alias("slope"), n)


def latest(days: DataFrame, columns: Sequence[str], day: str = "d") -> DataFrame:
    """Each column's last value that is there, and its day."""
    one = [F.max_by(F.struct(F.lit(c).alias("id"), F.col(day).alias("d"), finite(F.col(c)).alias("value")), F.when(S.is_num(F.col(c)), F.col(day))).alias(c) for c in columns]
    return days.agg(*one).select(F.explode(F.array(*columns)).alias("one")).where("one is not null").select("one.*")


def top_k(df: DataFrame, k: int, by: Column, tie: str) -> DataFrame:
    return df.orderBy(by.desc(), tie).limit(k)


def extent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[f(finite(F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def raw_beside_adjusted(adjusted: DataFrame, raw: DataFrame, on: str = "question") -> DataFrame:
    return adjusted.join(raw, on, "left")


def ranked_slots(df: DataFrame, by: str, keys: Sequence[str] = NONE, slots: int = 8) -> DataFrame:
    """Top categories keep a slot, the rest is ``other``."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return df.withColumn("slot", S.category_slot(F.row_number().over(w) - 1, slots))
