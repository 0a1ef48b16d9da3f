"""The daily panel's roles, bound to the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.days import calendar_spine
from .exports import SCHEMAS, Export
from .scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value and count for each day with orders."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).alias("n_orders"))


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity and mean discount for each day with shipments."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("x"), F.avg("l_discount").alias("disc"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each calendar day between the first and last order: ``d, y, n_orders, x, disc``.

    Facts are summed to days before anything is joined or windowed, so the spine
    and the windows see a row a day however large the facts are.  The panel is
    kept, so each fact table is scanned once for whatever is made of it.
    """
    orders = materialize(order_days(spark, sf_dir), "order-days")
    panel = calendar_spine(orders, "d").withColumn("n_orders", F.coalesce("n_orders", F.lit(0))).join(ship_days(spark, sf_dir), "d", "left")
    return materialize(panel, "daily")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer a day and priority: was any such order finished."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("question")).agg(F.max(F.col("o_orderstatus") == "F").alias("yes"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions: ``id, user_id, d, ts, activity, strain``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.to_date("ts").alias("d"), "ts", F.col("event_type").alias("activity"), F.col("value").alias("strain"))


def event_export(spark: SparkSession, sf_dir: str) -> Export:
    """Events as the four tables of an export for each user: purchases as cycles, views as naps and nights, clicks as workouts, the others as answers."""
    e = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "ord": F.col("event_id")})

    def fit(df: DataFrame, kind: str, **columns) -> DataFrame:
        parts = [f.strip().split(" ") for f in SCHEMAS[kind].split(",")]
        return df.select("user_id", *[(columns[n] if n in columns else F.col(n) if n in ("day", "ord") else F.lit(None)).cast(t).alias(n) for n, t in parts])

    of = lambda *kinds: e.where(F.col("event_type").isin(*kinds))
    later = lambda minutes: F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))
    value = F.col("value")
    odd = F.col("event_id") % 2 == 1
    cycles = fit(of("purchase"), "cycles", start=F.col("ts"), end=later(F.lit(1440)), sleepOnset=F.col("ts"), wakeOnset=later(value), recovery=value, strain=value / 10, asleep=F.when(odd, value * 2), rem=value / 2)
    sleeps = fit(of("view"), "sleeps", isNap=odd, sleepOnset=F.col("ts"), wakeOnset=later(value), asleep=F.when(F.col("event_id") % 3 != 0, value), rem=value / 4)
    workouts = fit(of("click"), "workouts", start=F.col("ts"), end=later(value), duration=value, activity=F.lit("click"), strain=value / 20, calories=value * 3, maxHr=value, avgHr=value / 2)
    journal = fit(of("signup", "error"), "journal", question=F.col("event_type"), yes=odd, notes=F.lit(""))
    return Export(cycles, sleeps, workouts, journal)
