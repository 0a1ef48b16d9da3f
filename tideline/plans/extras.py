"""Further panel metrics: regularity, social jet lag, episodes, polarisation, activity costs, year on year, a what-if simulator."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import scalars as S
from ..functions.student import student_quantile
from ..operators import days as D
from ..operators import stats
from ..operators.treefit import fit_models
from ..sources.bindings import daily, sessions, table
from .oracle import DAILY, SESSIONS, over_daily, put
from .queries import QUERIES, r


def regularity_index(nights: DataFrame, bed: str = "bedtime", wake: str = "wakeAdjusted", day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """How alike the sleeping minutes of consecutive days are, from -100 to 100, with nights as blocks.

    Two nights agree on every minute that lies in both blocks or in neither, so
    lengths and overlap tell the count.
    """
    w = D.by_day(keys, day)
    pairs = nights.select(*keys, day, F.col(bed).alias("b"), F.col(wake).alias("w"), F.lag(bed).over(w).alias("b0"), F.lag(wake).over(w).alias("w0"), F.lag(day).over(w).alias("before"))
    pairs = pairs.where((F.datediff(day, "before") == 1) & F.col("b").isNotNull() & F.col("w").isNotNull() & F.col("b0").isNotNull() & F.col("w0").isNotNull())
    overlap = F.greatest(F.lit(0), F.least("w", "w0") - F.greatest("b", "b0"))
    same = 1440 - ((F.col("w") - F.col("b")) + (F.col("w0") - F.col("b0")) - 2 * overlap)
    return pairs.groupBy(*keys).agg((200 * F.avg(same / 1440) - 100).alias("sri"), F.count(F.lit(1)).alias("n"))


def social_jet_lag(nights: DataFrame, bed: str = "bedtime", wake: str = "wakeAdjusted", day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Mean midpoints of sleep at weekends and otherwise, and the minutes between them."""
    mid = S.finite((F.col(bed) + F.col(wake)) / 2)
    free = S.weekday(F.col(day)).isin(0, 6)
    a, b = F.avg(F.when(free, mid)), F.avg(F.when(~free, mid))
    return nights.groupBy(*keys).agg(a.alias("weekend"), b.alias("weekdays"), F.abs(a - b).alias("lag_minutes"))


def nap_comparison(days: DataFrame, outcome: str, nap: str = "napMinutes", min_group: int = 8) -> DataFrame:
    """The outcome on days with and without naps; no row below ``min_group`` days of either."""
    out = stats.welch_t(days.withColumn("__nap", F.coalesce(F.col(nap) > 0, F.lit(False))), outcome, "__nap")
    return out.where((F.col("n_yes") >= min_group) & (F.col("n_no") >= min_group))


def episodes(days: DataFrame, x: str, above: float, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Runs of days above a level: ``first, last, length, peak``."""
    hit = days.where(S.finite(F.col(x)) > above)
    run = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return hit.withColumn("__g", run).groupBy(*keys, "__g").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("length"), F.max(x).alias("peak")).drop("__g")


def polarisation(sessions: DataFrame, zones: str = "zones", duration: str = "duration", day: str = "day") -> DataFrame:
    """Minutes of the two lowest over those of the two highest of five zones, by week."""
    part = lambda *at: F.sum(sum((F.coalesce(F.element_at(zones, i), F.lit(0.0)) for i in at), F.lit(0.0)) / 100 * F.col(duration))
    by = sessions.groupBy(S.iso_week(F.col(day)).alias("week")).agg(part(1, 2).alias("low"), part(4, 5).alias("high"))
    return by.select("week", F.try_divide("low", F.nullif("high", F.lit(0.0))).alias("polarisation"))


def activity_cost(days: DataFrame, sessions: DataFrame, outcome: str, day: str = "day", min_sessions: int = 8) -> DataFrame:
    """The next day's outcome after each activity against the mean of all days: ``activity, sessions, next_mean, cost``."""
    ahead = days.select(day, F.lead(outcome).over(D.by_day((), day)).alias("__next"))
    overall = days.agg(F.avg(S.finite(F.col(outcome))).alias("__all"))
    out = sessions.join(ahead, day).groupBy("activity").agg(F.count(F.lit(1)).alias("sessions"), F.avg(S.finite(F.col("__next"))).alias("next_mean")).where(F.col("sessions") >= min_sessions)
    return D.meet(out, overall).select("activity", "sessions", "next_mean", (F.col("next_mean") - F.col("__all")).alias("cost"))


def efficiency_trend(sessions: DataFrame, strain: str = "strain", rate: str = "avgHr", day: str = "day", min_sessions: int = 8) -> DataFrame:
    """Strain over mean heart rate for each activity, and its slope a day: ``activity, n, mean, slope``."""
    e = F.try_divide(F.col(strain), F.nullif(F.col(rate), F.lit(0.0)))
    t = F.datediff(F.col(day), F.lit("1970-01-01")).cast("double")
    out = sessions.withColumns({"__e": e, "__t": t}).groupBy("activity").agg(F.count("__e").alias("n"), F.avg("__e").alias("mean"), F.regr_slope("__e", "__t").alias("slope"))
    return out.where(F.col("n") >= min_sessions)


def year_over_year(days: DataFrame, x: str, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Each day beside the same day a year before: ``x, before, change``; the 29th of February meets the 28th."""
    past = days.select(*keys, F.col(day).alias("__d"), F.col(x).alias("before"))
    now = days.select(*keys, day, x, F.add_months(day, -12).alias("__d"))
    return now.join(past, [*keys, "__d"], "left").select(*keys, day, x, "before", (F.col(x) - F.col("before")).alias("change"))


PREDICTION = "ok boolean, n long, predicted double, low double, high double"


def simulate(days: DataFrame, outcome: str, at: dict[str, float], day: str = "day", level: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """A fitted model's prediction for given values of its regressors, with the interval of a new day."""
    x = list(at)

    def make(fit: L.Fit) -> pd.DataFrame:
        if not fit.ok:
            return pd.DataFrame([{"ok": False, "n": fit.n, "predicted": None, "low": None, "high": None}])
        point = np.array([1.0 if t == "const" else at[t] for t in fit.names()])
        value = float(point @ [t["coef"] for t in fit.terms])
        wide = student_quantile(1 - (1 - level) / 2, fit.df) * fit.sigma * float(np.sqrt(1 + point @ fit.xtx_inv @ point))
        return pd.DataFrame([{"ok": True, "n": fit.n, "predicted": value, "low": value - wide, "high": value + wide}])

    return fit_models(days, keys, outcome, x, make, PREDICTION, day=day, level=level)


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    """A product column for use as a regressor."""
    return df.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))


# --- queries and their SQL -----------------------------------------------------------------


def _nights(spark, sf):
    """A day's last bedtime and first waking, out of the events."""
    m = S.minute_of_day(F.col("ts"))
    return sessions(spark, sf).groupBy("d").agg(F.max(F.when(m < 1300, m)).cast("double").alias("bed"), (F.min(m) + 1440.0).alias("wake"))


_NIGHTS = "nights AS (SELECT d, CAST(max(minute) FILTER (minute < 1300) AS DOUBLE) AS bed, CAST(min(minute) + 1440 AS DOUBLE) AS wake FROM e GROUP BY d)"


def query(name):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


@query("regularity_index")
def _q(spark, sf):
    return regularity_index(_nights(spark, sf), "bed", "wake", "d").select(r("sri", 6), "n")


put(
    "regularity_index",
    """SELECT round(200 * avg((1440 - ((w - b) + (w0 - b0) - 2 * greatest(0, least(w, w0) - greatest(b, b0)))) / 1440) - 100, 6) + 0.0 AS sri, count(*) AS n
FROM (SELECT d, bed AS b, wake AS w, lag(bed) OVER (ORDER BY d) AS b0, lag(wake) OVER (ORDER BY d) AS w0, lag(d) OVER (ORDER BY d) AS d0 FROM nights) WHERE date_diff('day', d0, d) = 1 AND b IS NOT NULL AND b0 IS NOT NULL""",
    SESSIONS,
    _NIGHTS,
)


@query("social_jet_lag")
def _q(spark, sf):  # noqa: F811
    return social_jet_lag(_nights(spark, sf), "bed", "wake", "d").select(r("weekend"), r("weekdays"), r("lag_minutes"))


put(
    "social_jet_lag",
    "SELECT round(a, 4) + 0.0 AS weekend, round(b, 4) + 0.0 AS weekdays, round(abs(a - b), 4) + 0.0 AS lag_minutes FROM (SELECT avg((bed + wake) / 2) FILTER (dayofweek(d) IN (0, 6)) AS a, avg((bed + wake) / 2) FILTER (dayofweek(d) NOT IN (0, 6)) AS b FROM nights)",
    SESSIONS,
    _NIGHTS,
)


@query("nap_comparison")
def _q(spark, sf):  # noqa: F811
    d = daily(spark, sf).withColumn("nap", F.greatest(F.lit(0.0), F.col("x") - 600))
    return nap_comparison(d, "y", "nap").select(r("mean_yes"), r("mean_no"), r("delta"), "n_yes", "n_no")


over_daily(
    "nap_comparison",
    "SELECT round(a, 4) + 0.0 AS mean_yes, round(b, 4) + 0.0 AS mean_no, round(a - b, 4) + 0.0 AS delta, n_yes, n_no FROM (SELECT avg(y) FILTER (g) AS a, avg(y) FILTER (NOT g) AS b, count(y) FILTER (g) AS n_yes, count(y) FILTER (NOT g) AS n_no FROM (SELECT y, coalesce(x > 600, false) AS g FROM daily)) WHERE n_yes >= 8 AND n_no >= 8",
)


@query("episodes")
def _q(spark, sf):  # noqa: F811
    return episodes(daily(spark, sf), "x", 700.0, "d").select("first", "last", "length", r("peak"))


over_daily("episodes", "SELECT min(d) AS first, max(d) AS last, count(*) AS length, round(max(x), 4) + 0.0 AS peak FROM (SELECT d, x, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS g FROM daily WHERE x > 700) GROUP BY g")


@query("polarisation")
def _q(spark, sf):  # noqa: F811
    share = F.array(F.col("l_discount") * 100, F.col("l_tax") * 100, F.lit(10.0), F.lit(5.0) + F.col("l_linenumber"), F.lit(20.0))
    l = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), share.alias("zones"), F.col("l_quantity").alias("duration"))
    return polarisation(l, "zones", "duration", "d").select("week", r("polarisation", 6))


put("polarisation", "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, round(sum((l_discount * 100 + l_tax * 100) / 100 * l_quantity) / sum((5 + l_linenumber + 20) / 100 * l_quantity), 6) + 0.0 AS polarisation FROM lineitem GROUP BY 1")


@query("activity_cost")
def _q(spark, sf):  # noqa: F811
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("activity"), F.to_date("l_shipdate").alias("d"))
    return activity_cost(daily(spark, sf), l, "y", "d").select("activity", "sessions", r("next_mean"), r("cost"))


over_daily(
    "activity_cost",
    "SELECT l_returnflag AS activity, count(*) AS sessions, round(avg(nx), 4) + 0.0 AS next_mean, round(avg(nx) - (SELECT avg(y) FROM daily), 4) + 0.0 AS cost FROM lineitem JOIN (SELECT d, lead(y) OVER (ORDER BY d) AS nx FROM daily) a ON CAST(l_shipdate AS DATE) = a.d GROUP BY 1 HAVING count(*) >= 8",
)


@query("efficiency_trend")
def _q(spark, sf):  # noqa: F811
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("activity"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("strain"), F.col("l_quantity").cast("double").alias("rate"))
    return efficiency_trend(l, "strain", "rate", "d").select("activity", "n", r("mean"), r("slope", 6))


put("efficiency_trend", "SELECT l_returnflag AS activity, count(*) AS n, round(avg(l_extendedprice / l_quantity), 4) + 0.0 AS mean, round(regr_slope(l_extendedprice / l_quantity, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))), 6) + 0.0 AS slope FROM lineitem GROUP BY 1")


@query("year_over_year")
def _q(spark, sf):  # noqa: F811
    return year_over_year(daily(spark, sf), "x", "d").select("d", r("x"), r("before"), r("change"))


over_daily("year_over_year", "SELECT a.d, round(a.x, 4) + 0.0 AS x, round(b.x, 4) + 0.0 AS before, round(a.x - b.x, 4) + 0.0 AS change FROM daily a LEFT JOIN daily b ON b.d = CAST(a.d - INTERVAL 12 MONTH AS DATE)")


@query("simulate")
def _q(spark, sf):  # noqa: F811
    d = daily(spark, sf).select("d", (F.col("y") / 1e4).alias("y"), (F.col("x") / 1e3).alias("x"), F.col("n_orders").cast("double").alias("n_orders"))
    return simulate(interaction(d, "x", "n_orders"), "y", {"x": 0.6, "n_orders": 6.0, "x_x_n_orders": 3.6}, "d")


__all__ = ["DAILY", "activity_cost", "efficiency_trend", "episodes", "interaction", "nap_comparison", "polarisation", "regularity_index", "simulate", "social_jet_lag", "year_over_year"]
