"""Binned means and local regression, as grids against data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize
from . import ranges
from .treefit import key_json, with_keys

NONE: Sequence[str] = ()


def complete_pairs(df: DataFrame, x: str, y: str, keys: Sequence[str] = NONE, order: str | None = None) -> DataFrame:
    rows = df.where(S.is_num(F.col(x)) & S.is_num(F.col(y)))
    return rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(order or x).alias("ord"))


def binscatter(df: DataFrame, x: str, y: str, bins: int = 20, min_per_bin: int = 3, keys: Sequence[str] = NONE, order: str | None = None) -> DataFrame:
    """Means of y in bins of equal counts along x: ``bin, x, y, se, n, x_low, x_high``.

    Bin b holds the ranks from ``floor(b n / bins)`` to before
    ``floor((b + 1) n / bins)``, so the bin of a rank follows in closed form.
    """
    pairs = complete_pairs(df, x, y, keys, order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("x", "ord")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    placed = pairs.withColumns({"__r": rank.cast("long"), "__n": n}).withColumn("bin", F.floor(((F.col("__r") + 1) * bins - 1) / F.col("__n")).cast("long"))
    out = placed.groupBy(*keys, "bin").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), (F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x_low"), F.max("x").alias("x_high")
    )
    return out.where(F.col("n") >= max(2, min_per_bin))


def loess(df: DataFrame, x: str, y: str, bandwidth: float = 0.3, points: int = 60, keys: Sequence[str] = NONE, order: str | None = None) -> DataFrame:
    """A local line with tricube weights at ``points`` places along x: ``x, y``.

    Each place takes its nearest ``round(bandwidth n)`` rows; of equally near ones
    the smaller x, then the earlier row.  Rows are ranked once.  The nearest ones
    are a stretch of ranks, and where it begins is a count: as long as the row
    that it would lose is farther than the row that it would gain, it moves on.
    So places meet only the rows that they take.  Where the stretch begins within
    rows of one x, the earliest of those take its place there.
    """
    pairs = complete_pairs(df, x, y, keys, order).select(key_json(keys).alias("key"), "x", "y", "ord")
    rows = materialize(ranges.running(pairs, ["key"], ["x", "ord"], "r", label="loess-ranks"), "loess-rows")
    span = rows.groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    size = F.greatest(F.lit(2), F.least(F.col("n"), F.floor(bandwidth * F.col("n") + 0.5))).cast("long")
    sizes = materialize(span.select("key", "a", ((F.col("b") - F.col("a")) / (points - 1)).alias("step"), size.alias("size")), "loess-sizes")
    grid = sizes.select("key", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"), "a", "step", "size").select("key", "g", (F.col("a") + F.col("g") * F.col("step")).alias("gx"), "size")
    few = (lambda d: d) if keys else F.broadcast  # without keys as many rows as there are points
    sized = rows.join(few(sizes.select(F.col("key").alias("of"), "size")), F.col("key") == F.col("of")).drop("of")
    gained = sized.select(F.col("key").alias("of"), (F.col("r") - F.col("size")).alias("lost"), F.col("x").alias("x_gained"))
    moves = rows.select("key", "r", "x").join(gained, (F.col("key") == F.col("of")) & (F.col("r") == F.col("lost"))).drop("of", "lost")
    wanted = grid.select(F.col("key").alias("of"), "g", "gx")
    on = F.when(F.col("gx") - F.col("x") > F.col("x_gained") - F.col("gx"), 1)
    starts = moves.join(few(wanted), F.col("key") == F.col("of")).groupBy("key", "g").agg(F.count(on).alias("moved")).select(F.col("key").alias("of"), F.col("g").alias("at"), "moved")
    begun = grid.join(starts, (F.col("key") == F.col("of")) & (F.col("g") == F.col("at")), "left").select("key", "g", "gx", "size", (F.coalesce("moved", F.lit(0)) + 1).alias("start"))
    ends = begun.withColumn("end", F.col("start") + F.col("size") - 1)
    first, last = (rows.select(F.col("key").alias("of"), F.col("r").alias("at"), F.col("x").alias(n)) for n in ("x_first", "x_last"))
    placed = ends.join(first, (F.col("key") == F.col("of")) & (F.col("start") == F.col("at"))).drop("of", "at")
    placed = materialize(placed.join(last, (F.col("key") == F.col("of")) & (F.col("end") == F.col("at"))).drop("of", "at"), "loess-places")
    begins = placed.select(F.col("key").alias("of"), F.col("x_first").alias("value")).distinct()
    ties = rows.join(few(begins), (F.col("key") == F.col("of")) & (F.col("x") == F.col("value"))).groupBy("key", "x").agg(F.min("r").alias("tie_from"), F.max("r").alias("tie_to"))
    tied = ties.select(F.col("key").alias("of"), F.col("x").alias("value"), "tie_from", "tie_to")
    spans = placed.join(tied, (F.col("key") == F.col("of")) & (F.col("x_first") == F.col("value"))).select(
        F.col("key").alias("of"), "g", "gx", "tie_from", (F.col("tie_from") + F.least("tie_to", "end") - F.col("start")).alias("tie_last"), (F.col("tie_to") + 1).alias("then"), "end",
        F.greatest(F.abs(F.col("x_first") - F.col("gx")), F.abs(F.col("x_last") - F.col("gx"))).alias("far"),
    )
    taken = F.col("r").between(F.col("tie_from"), F.col("tie_last")) | F.col("r").between(F.col("then"), F.col("end"))
    picked = rows.join(few(spans), (F.col("key") == F.col("of")) & taken).withColumn("d", F.abs(F.col("x") - F.col("gx")))
    weight = F.when(F.col("far") <= 0, 1.0).otherwise(F.pow(1 - F.pow(F.col("d") / F.col("far"), 3), 3))
    w = picked.withColumn("w", weight)
    wx, wy, wxx, wxy = (F.sum(F.col("w") * c) for c in (F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y")))
    sums = w.groupBy("key", "g", "gx").agg(F.sum("w").alias("sw"), wx.alias("swx"), wy.alias("swy"), wxx.alias("swxx"), wxy.alias("swxy"), F.min_by("y", F.struct("d", "x", "ord")).alias("nearest"))
    sxx = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw")
    sxy = F.col("swxy") - F.col("swx") * F.col("swy") / F.col("sw")
    slope = F.when(F.abs(sxx) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("swxx")), 0.0).otherwise(F.try_divide(sxy, sxx))
    fitted = F.when(F.col("sw") > 0, F.col("swy") / F.col("sw") + slope * (F.col("gx") - F.col("swx") / F.col("sw"))).otherwise(F.col("nearest"))
    return with_keys(sums.select("key", F.col("gx").alias("x"), fitted.alias("y")), keys, df)
