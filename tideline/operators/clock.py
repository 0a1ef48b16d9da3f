"""The daily clock of sleep and sessions, and weekly loads by activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def clock_quartiles(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``kind, n, q1, med, q3`` of clock minutes: quartiles on the shifted scale, then wrapped to a day."""
    rows = []
    for c in columns:
        v = S.finite(F.col(c))
        q = F.percentile(v, [0.25, 0.5, 0.75])
        wrapped = [F.pmod(F.element_at(q, i), F.lit(1440.0)).alias(n) for i, n in ((1, "q1"), (2, "med"), (3, "q3"))]
        rows.append(F.struct(F.lit(c).alias("kind"), F.count(v).alias("n"), *wrapped))
    return days.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def sleep_window(days: DataFrame, bed: str = "bedtime", wake: str = "wakeTime", min_n: int = 21) -> DataFrame:
    """Nights, both medians and the minutes between them; the count is the smaller of the two columns'."""
    q = clock_quartiles(days, [bed, wake]).groupBy().pivot("kind", [bed, wake]).agg(F.first("med").alias("med"), F.first("n").alias("n"))
    b, w, n = F.col(f"{bed}_med"), F.col(f"{wake}_med"), F.least(F.col(f"{bed}_n"), F.col(f"{wake}_n"))
    minutes = w + 1440 - F.when(b < 720, b + 1440).otherwise(b)
    ok = n >= min_n
    return q.select(ok.alias("ok"), n.alias("n"), F.lit(min_n).cast("long").alias("min_n"), F.greatest(F.lit(0), min_n - n).cast("long").alias("missing"), *[F.when(ok, c).alias(a) for c, a in ((b, "bed"), (w, "wake"), (minutes, "window_minutes"))])


def clock_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with a start and strain by activity, the heaviest first: ``activity, sessions, strain, max_strain``."""
    good = sessions.where(F.col("ts").isNotNull() & S.is_num(F.col("strain")))
    return good.groupBy("activity").agg(F.count(F.lit(1)).alias("sessions"), F.sum("strain").alias("strain"), F.max("strain").alias("max_strain")).orderBy(F.desc("strain"), "activity")


def session_list(sessions: DataFrame, day: str = "d") -> DataFrame:
    """Every session with a start and strain at its minute of the day: ``day, minute_of_day, strain, activity``, and ``duration`` where there is one."""
    good = sessions.where(F.col("ts").isNotNull() & S.is_num(F.col("strain")))
    more = ["duration"] if "duration" in sessions.columns else []
    return good.select(F.col(day).alias("day"), S.minute_of_day(F.col("ts")).cast("long").alias("minute_of_day"), F.col("strain").cast("double").alias("strain"), *more, "activity")


def circadian_clock(days: DataFrame, sessions: DataFrame, bed: str = "bedtime", wake: str = "wakeTime", recovery: str = "recovery", min_n: int = 21) -> DataFrame:
    """``sleep_window`` beside the mean recovery of all days, the heaviest session and the number of sessions; those only where there are enough nights."""
    window = sleep_window(days, bed, wake, min_n)
    mean = days.agg(F.avg(S.finite(F.col(recovery))).alias("mean_recovery"))
    top = session_list(sessions.withColumn("d", F.to_date("ts"))).agg(F.coalesce(F.max("strain"), F.lit(0.0)).alias("max_strain"), F.count(F.lit(1)).alias("sessions"))
    both = window.join(F.broadcast(mean)).join(F.broadcast(top))  # one row each
    return both.select(*window.columns, *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("mean_recovery", "max_strain", "sessions")])


def clock_hours(rows: DataFrame, minute: str, value: str, min_n: int = 5) -> DataFrame:
    """``hour, mean, n`` of a value by hour of the day, the mean null where an hour has too few."""
    hour = F.floor(S.clock_wrap(F.col(minute)) / 60).cast("long")
    v = S.finite(F.col(value))
    return rows.where(F.col(minute).isNotNull()).groupBy(hour.alias("hour")).agg(F.when(F.count(v) >= min_n, F.avg(v)).alias("mean"), F.count(v).alias("n"))


def heaviest(sessions: DataFrame, rows: int) -> DataFrame:
    """``activity, __t`` of the activities of most strain, found by a top-k and not by ranking all."""
    return sessions.groupBy("activity").agg(F.sum("strain").alias("__t")).orderBy(F.col("__t").desc(), "activity").limit(rows)


def activity_week_load(sessions: DataFrame, day: str = "d", rows: int = 12) -> DataFrame:
    """Strain and sessions of the heaviest activities on contiguous Monday weeks: ``activity, week, strain, sessions, rk``.

    Weeks without a session have null strain and no sessions.  The spine is
    weeks times at most ``rows`` activities.
    """
    by = sessions.groupBy("activity", S.iso_week(F.col(day)).alias("week")).agg(F.sum("strain").alias("strain"), F.count(F.lit(1)).alias("sessions"))
    top = heaviest(sessions, rows)
    rank = F.row_number().over(Window.orderBy(F.col("__t").desc(), "activity"))  # at most ``rows`` rows
    top = top.withColumn("rk", rank.cast("long")).select("activity", "rk")
    span = sessions.agg(S.iso_week(F.min(day)).alias("a"), S.iso_week(F.max(day)).alias("b")).where("a is not null")
    weeks = span.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    spine = top.withColumn("__on", F.lit(1)).join(weeks.withColumn("__on", F.lit(1)), "__on").drop("__on")
    return spine.join(by, ["activity", "week"], "left").select("activity", "week", "strain", F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"), "rk")


def remainder(sessions: DataFrame, rows: int = 12) -> DataFrame:
    """How many activities the table above leaves out, and their strain."""
    totals = sessions.groupBy("activity").agg(F.sum("strain").alias("t"))
    top = heaviest(sessions, rows).select(F.col("activity").alias("of"))
    rest = totals.join(F.broadcast(top), F.col("activity").eqNullSafe(F.col("of")), "left_anti")  # at most ``rows`` rows
    return rest.agg(F.count(F.lit(1)).alias("activities"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("strain"))
