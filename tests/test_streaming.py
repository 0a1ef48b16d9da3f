"""The streaming forms against their batch results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tideline.streaming import panel


def test_daily_totals(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, d, h), float(h)) for k in ("a", "b") for d in (1, 2, 3) for h in (1, 9, 20)]
    spark.createDataFrame(rows, "key string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp_ntz, value double").parquet(f"{tmp_path}/in")
    q = panel.daily_totals(stream, ["key"]).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("totals").collect()
    assert len(got) == 6 and all(r["total"] == 30 and r["n"] == 3 for r in got)


def test_control_chart_carries_state(spark, tmp_path):
    schema = "key string, t long, v double"
    for part, span in enumerate((range(0, 5), range(5, 10))):
        spark.createDataFrame([("a", t, 12.0) for t in span], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = panel.control_chart(stream, 10.0, 1.0).writeStream.format("memory").queryName("chart").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("chart").orderBy("t").select("t", F.round("high", 3).alias("high"), "signal").collect()
    assert len(got) == 10 and [r["signal"] for r in got].count("high") == 2
