"""Streaming forms of the panel: daily totals with late data, and control charts with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_totals(events: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """``keys, d, total, mean, n`` for each day, final once the watermark has passed it."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = stamped.groupBy(*keys, F.window("__ts", "1 day").alias("w")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.to_date("w.start").alias("d"), "total", "mean", "n")


CHART = "key string, t long, z double, high double, low double, signal string"


def control_chart(points: DataFrame, mean: float, sd: float, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """The two-sided cumulative sums of ``key, t, v`` against a known baseline, the sums kept as state by key.

    Points of a micro-batch are taken in order of t; a missing value carries the
    sums; the side that signals starts over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high, low = state.get if state.exists else (0.0, 0.0)
        rows = []
        for t, v in pd.concat(list(batches)).sort_values("t")[["t", "v"]].itertuples(index=False):
            z = None if pd.isna(v) else (v - mean) / sd
            if z is not None:
                high, low = max(0.0, high + z - k), max(0.0, low - z - k)
            signal = None if z is None else "high" if high > h else "low" if low > h else None
            rows.append((key[0], t, z, high, low, signal))
            high, low = (0.0 if signal == "high" else high), (0.0 if signal == "low" else low)
        state.update((high, low))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHART.split(", ")])

    return points.groupBy("key").applyInPandasWithState(step, CHART, "high double, low double", "append", GroupStateTimeout.NoTimeout)


def recompute_days(days_of, target: str):
    """A ``foreachBatch`` function: rolling columns of the panel are recomputed from all facts so far.

    Row windows over a gap-free calendar can't be kept incrementally when days
    arrive late; the daily totals are small, so their windows are run again.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        days_of(batch.sparkSession).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return each
