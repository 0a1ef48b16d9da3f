"""Exact quantiles with bounded memory, by narrowing in on their ranks.

``percentile`` holds a map of all distinct values of a group.  Here an open
interval of more than ``SORTED`` values is counted in ``BUCKETS`` equal parts; the
parts that hold wanted ranks are the next intervals, narrowed to the least and
largest value in them.  A pass is one aggregation with partial sums, and ranks of
one part share it, so a value is counted once a pass.  Intervals of up to ``SORTED``
values are sorted.  Most entities are such an interval from the start, so their
values are shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize

NONE: Sequence[str] = ()
BUCKETS = 1024
#: Values of an interval that are sorted in one task.
SORTED = 65_536


def exact_quantiles(df: DataFrame, x: str, probabilities: Sequence[float], keys: Sequence[str] = NONE, buckets: int = BUCKETS, most: int = SORTED) -> DataFrame:
    """``probability, quantile, n`` of each entity's finite values, interpolated between the two ranks next to it; an entity without values gives no rows.

    Only entities of more than ``most`` values are narrowed; each pass reads all
    values, of which values spread over d orders of magnitude take about
    d / log10(buckets) at most.
    """
    v = S.finite(F.col(x))
    # Structs compare with nulls as equal.
    key = F.struct(*keys) if keys else F.lit("")
    rows = materialize(df.where(v.isNotNull()).select(key.alias("key"), v.alias("v")), "quantile-values")
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    asked = sizes.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    at = F.col("probability") * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(float(p)) * (F.col("n") - 1)), F.ceil(F.lit(float(p)) * (F.col("n") - 1))) for p in probabilities])))
    # Intervals of an entity don't meet; beneath ``before`` lie the values left of one, and it holds ``n``.
    whole = sizes.select("key", "lo", "hi", F.lit(0).cast("long").alias("before"), "n", ranks.alias("ranks"))
    large = (F.col("lo") < F.col("hi")) & (F.col("n") > most)
    small, todo = whole.where(~large), materialize(whole.where(large), "quantile-intervals")
    narrowed = todo.where("false")
    # Values of entities that are narrowed don't go through the shuffle by entity.
    rest = rows if todo.isEmpty() else rows.join(todo.select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_anti")

    def inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
        """The values of intervals, with them; without keys there are at most two for each probability."""
        named = intervals.withColumnRenamed("key", "of")
        return values.join(named if keys else F.broadcast(named), (F.col("key") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("of")

    while not todo.isEmpty():
        place = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).cast("int")
        cells = inside(rows, todo.drop("n")).groupBy("key", "before", place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("ranks").alias("ranks"))
        upto = F.coalesce(F.sum("n").over(Window.partitionBy("key", "before").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
        held = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        next_ = materialize(cells.withColumn("before", upto).withColumn("ranks", held).where(F.size("ranks") > 0).select("key", "lo", "hi", "before", "n", "ranks"), "quantile-intervals")
        narrowed, todo = narrowed.unionByName(next_.where(~large)), next_.where(large)
    nth = F.row_number().over(Window.partitionBy("key", "before").orderBy("v")) - 1 + F.col("before")
    parts = [small.unionByName(narrowed).where("lo = hi").select("key", F.explode("ranks").alias("rank"), F.col("lo").alias("value"))]
    for values, intervals in ((rest, small.hint("shuffle_hash") if keys else small), (rows, narrowed)):
        ranked = inside(values, intervals.where("lo < hi").drop("n")).withColumn("rank", nth)
        parts.append(ranked.where(F.array_contains("ranks", F.col("rank"))).select("key", "rank", F.col("v").alias("value")))
    found = materialize(reduce(DataFrame.unionByName, parts), "quantile-found")
    low, high = found.toDF("of_low", "low_rank", "low"), found.toDF("of_high", "high_rank", "high")
    placed = asked.select("key", "n", "probability", at.alias("at"))
    out = placed.join(low, (F.col("key") == F.col("of_low")) & (F.floor("at") == F.col("low_rank"))).join(high, (F.col("key") == F.col("of_high")) & (F.ceil("at") == F.col("high_rank")))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    return out.select(*[F.col("key").getField(k).alias(k) for k in keys], "probability", value.alias("quantile"), "n")
