"""The day model: one gap-free row for each entity and calendar day.

Every operator takes ``keys``, the columns of an entity; with none there is one
entity.  Facts are aggregated to days before any window, so a window partition
holds an entity's days and never its facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.exports import _CYCLE, _SLEEP, Export

SHORT, LONG = 7, 28
NONE: Sequence[str] = ()


def by_day(keys: Sequence[str] = NONE, day: str = "d"):
    return Window.partitionBy(*keys).orderBy(day)


def trailing(width: int, keys: Sequence[str] = NONE, day: str = "d"):
    return by_day(keys, day).rowsBetween(-(width - 1), Window.currentRow)


def meet(rows: DataFrame, per_entity: DataFrame, keys: Sequence[str] = NONE) -> DataFrame:
    """Rows beside what was aggregated for their entity.

    Without keys that is one entity, whose few rows are broadcast; with keys
    there may be any number, so the sides meet by an ordinary join.
    """
    return rows.join(per_entity, list(keys)) if keys else rows.join(F.broadcast(per_entity))


def calendar_spine(df: DataFrame, day: str = "d", keys: Sequence[str] = NONE) -> DataFrame:
    """Every day from an entity's first to its last, with its row where it has one."""
    span = df.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b")).where(F.col("__a").isNotNull())
    return span.select(*keys, F.explode(F.sequence("__a", "__b")).alias(day)).join(df, [*keys, day], "left")


def rolling_mean(x: Column, width: int, keys: Sequence[str] = NONE, day: str = "d") -> Column:
    """Mean of the trailing rows, null below two fifths of them (and below two)."""
    w, x = trailing(width, keys, day), S.finite(x)
    return F.when(F.count(x).over(w) >= max(2, int(0.4 * width)), F.avg(x).over(w))


def rolling_sd(x: Column, width: int, keys: Sequence[str] = NONE, day: str = "d") -> Column:
    """Sample deviation of the trailing rows, from two values on."""
    return F.stddev_samp(S.finite(x)).over(trailing(width, keys, day))


def rolling_z(x: Column, width: int = LONG, keys: Sequence[str] = NONE, day: str = "d") -> Column:
    return F.try_divide(x - rolling_mean(x, width, keys, day), F.nullif(rolling_sd(x, width, keys, day), F.lit(0.0)))


def load_ratio(x: Column, keys: Sequence[str] = NONE, day: str = "d") -> Column:
    """Short over long rolling mean."""
    return F.try_divide(rolling_mean(x, SHORT, keys, day), F.nullif(rolling_mean(x, LONG, keys, day), F.lit(0.0)))


def lagged(x: Column, lag: int, scale: float = 1.0, keys: Sequence[str] = NONE, day: str = "d") -> Column:
    """The scaled value some rows back (rows are days on a spine); what isn't finite is missing."""
    moved = F.lag(x, lag).over(by_day(keys, day)) if lag else x
    return S.finite(moved * scale)


def latest_per_day(df: DataFrame, day: str, order: str | Column, keys: Sequence[str] = NONE) -> DataFrame:
    """Of a day's rows the last one with all its columns, nulls included; an aggregate, so facts are not sorted."""
    order = F.col(order) if isinstance(order, str) else order
    return _chosen(df, F.max_by(F.struct(*df.columns), F.struct(order)), day, keys)


def _chosen(df: DataFrame, row: Column, day: str, keys: Sequence[str]) -> DataFrame:
    on = [*keys, day]
    picked = df.groupBy(*[F.col(c).alias(f"__{c}") for c in on]).agg(row.alias("__row"))
    return picked.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def nap_minutes(sleeps: DataFrame, keys: Sequence[str] = NONE) -> DataFrame:
    return sleeps.where("isNap").groupBy(*keys, "day").agg(F.sum(F.coalesce("asleep", F.lit(0.0))).alias("napMinutes"))


def first_with(df: DataFrame, value: str, day: str, order: str, keys: Sequence[str] = NONE) -> DataFrame:
    """Of a day's rows the first that has the value, else the last: what filling in order until it is there leaves."""
    whole = F.struct(*df.columns)
    has = F.col(value).isNotNull()
    first = F.min_by(F.when(has, whole), F.when(has, F.struct(order)))
    return _chosen(df, F.coalesce(first, F.max_by(whole, F.struct(order))), day, keys)


def journal_last(journal: DataFrame, keys: Sequence[str] = NONE, day: str = "day", order: str = "ord") -> DataFrame:
    """The last answer to each question of a day."""
    return journal.groupBy(*keys, day, "question").agg(F.max_by("yes", order).alias("yes"))


def question_counts(journal: DataFrame, order: str = "ord") -> DataFrame:
    return journal.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").drop("first")


def known_days(tables: Sequence[DataFrame], keys: Sequence[str] = NONE, day: str = "day") -> DataFrame:
    """Every day that any of the tables has, once."""
    return reduce(DataFrame.unionByName, [t.select(*keys, day) for t in tables]).distinct()


def build_days(export: Export, keys: Sequence[str] = NONE) -> DataFrame:
    """The day panel of an export: raw, derived and rolling columns on a gap-free calendar."""
    cycles = latest_per_day(export.cycles, "day", "ord", keys).drop("ord")
    nights = first_with(export.sleeps.where(~F.col("isNap")), "asleep", "day", "ord", keys)
    filled = ["sleepOnset", "wakeOnset", *_SLEEP]
    nights = nights.select(*keys, "day", *[F.col(c).alias(f"__{c}") for c in filled], F.lit(True).alias("__night"))
    parts = ["start", "end", "duration", "activity", "strain", "calories", "maxHr", "avgHr", "zones", "distance", "altitudeGain"]
    workouts = export.workouts.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct("ord", *parts))).alias("workouts"))
    answers = journal_last(export.journal, keys).groupBy(*keys, "day").agg(F.map_from_entries(F.collect_list(F.struct("question", "yes"))).alias("journal"))
    on = [*keys, "day"]
    joined = calendar_spine(known_days((export.cycles, export.sleeps, export.workouts, export.journal), keys), "day", keys)
    for part in (cycles, nights, nap_minutes(export.sleeps, keys), workouts, answers):
        joined = joined.join(part, on, "left")
    # A night from the sleep table stands in wherever the cycle has no sleep.
    stands_in = F.col("asleep").isNull() & F.coalesce("__night", F.lit(False))
    joined = joined.withColumns({c: F.when(stands_in, F.col(f"__{c}")).otherwise(F.col(c)) for c in filled}).drop(*[f"__{c}" for c in filled], "__night")
    total = lambda f: F.aggregate(F.coalesce("workouts", F.array()), F.lit(0.0), lambda a, w: a + F.coalesce(w[f], F.lit(0.0)))
    derived = joined.withColumns({
        "weekday": S.weekday(F.col("day")), "month": S.month0(F.col("day")), "sleepHours": F.col("asleep") / 60,
        "remShare": S.share(F.col("rem"), F.col("asleep")), "deepShare": S.share(F.col("deep"), F.col("asleep")), "lightShare": S.share(F.col("light"), F.col("asleep")),
        "bedtime": S.bedtime_minute(F.col("sleepOnset")).cast("double"), "wakeTime": S.minute_of_day(F.col("wakeOnset")).cast("double"),
        "bedtimeHours": S.bedtime_minute(F.col("sleepOnset")) / 60, "wakeAdjusted": (S.minute_of_day(F.col("wakeOnset")) + S.DAY_MINUTES).cast("double"),
        "workoutMinutes": total("duration"), "workoutCount": F.when(F.col("workouts").isNull(), 0).otherwise(F.size("workouts")),
    })
    return attach_windows(derived, keys)


def attach_windows(days: DataFrame, keys: Sequence[str] = NONE) -> DataFrame:
    """Rolling baselines, z-score, load ratio and neighbours; all windows share one partitioning."""
    roll = lambda c, n: rolling_mean(F.col(c), n, keys, "day")
    out = days.withColumns(
        {f"{c}{n}": roll(c, n) for c in ("recovery", "hrv", "rhr", "strain") for n in (SHORT, LONG)} | {f"{c}7": roll(c, SHORT) for c in ("remShare", "deepShare")}
    )
    return out.withColumns({
        "hrvZ": F.try_divide(F.col("hrv") - F.col("hrv28"), F.nullif(rolling_sd(F.col("hrv"), LONG, keys, "day"), F.lit(0.0))),
        "acwr": F.try_divide(F.col("strain7"), F.nullif(F.col("strain28"), F.lit(0.0))),
        "recoveryNext": F.lead("recovery").over(by_day(keys, "day")), "strainPrev": F.lag("strain").over(by_day(keys, "day")),
    })


def bedtime_variability(days: DataFrame, bed: str = "bedtime", keys: Sequence[str] = NONE) -> DataFrame:
    """``n, sd``: how much bedtimes spread, in minutes."""
    v = S.finite(F.col(bed))
    return days.groupBy(*keys).agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"))


def by_week(days: DataFrame, metrics: Sequence[str], day: str = "d", keys: Sequence[str] = NONE) -> DataFrame:
    """Means and row counts of Monday weeks; a total is mean times count."""
    return days.groupBy(*keys, S.iso_week(F.col(day)).alias("week")).agg(F.count(F.lit(1)).alias("count"), *[F.avg(S.finite(F.col(m))).alias(m) for m in metrics])


def select_window(days: DataFrame, size: int, day: str = "d", keys: Sequence[str] = NONE) -> DataFrame:
    """The last ``size`` days as ``current`` and the days before, as many at most, as ``previous``.

    On a spine a row's distance from the last day is a difference of dates, so
    the two cut-offs are one aggregate and the filter reaches the scan.
    """
    last = days.groupBy(*keys).agg(F.max(day).alias("__last"), F.count(F.lit(1)).alias("__n"))
    back = F.datediff(F.col("__last"), F.col(day))
    whole = (F.lit(size) == 0) | (F.lit(size) >= F.col("__n"))
    joined = meet(days, last, keys)
    period = F.when(whole | (back < size), "current").when(back < 2 * size, "previous")
    return joined.withColumn("period", period).where(F.col("period").isNotNull()).drop("__last", "__n")


def calendar_grid(days: DataFrame, day: str = "d") -> DataFrame:
    """Column (week) and row (weekday) of each day in a calendar that starts on the first day's week."""
    first = days.agg(F.min(day).alias("__first"))
    place = F.datediff(F.col(day), F.col("__first")) + S.weekday(F.col("__first"))
    return days.join(F.broadcast(first)).select(day, F.floor(place / 7).cast("long").alias("col"), F.pmod(place, F.lit(7)).cast("long").alias("row"))


def granularity(n_days: int, limit: int = 120) -> str:
    return "week" if n_days > limit else "day"


def marker_rows(days: DataFrame, markers: DataFrame, day: str = "d") -> DataFrame:
    """Markers with the row number of their day."""
    numbered = days.withColumn("row", F.datediff(F.col(day), F.min(day).over(Window.partitionBy())))
    return markers.join(numbered.select(day, "row"), day)


def stacked_total(*layers: Column) -> Column:
    total = F.lit(0.0)
    for layer in layers:
        total = total + F.coalesce(layer, F.lit(0.0))
    return total
