"""False-discovery control over families of tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def benjamini_hochberg(tests: DataFrame, p: str = "p", order: str = "id", family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """``q``, ``rank`` and ``sig`` beside each test of a family; null p-values pass through and don't count.

    The m-th over j-th multiple of a p-value, then the running minimum from the
    largest p-value down.  Tests of one family share a window partition.
    ``tests`` is read once and kept.
    """
    tests = materialize(tests, "tests")
    known = tests.where(F.col(p).isNotNull())
    up = Window.partitionBy(*family).orderBy(p, order)
    down = Window.partitionBy(*family).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = known.withColumns({"rank": F.row_number().over(up).cast("long"), "__m": F.count(F.lit(1)).over(Window.partitionBy(*family))})
    out = ranked.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(F.col("__m") / F.col("rank") * F.col(p)).over(down)))).withColumn("sig", F.col("q") <= alpha).drop("__m")
    none = tests.where(F.col(p).isNull()).withColumns({"rank": F.lit(None).cast("long"), "q": F.lit(None).cast("double"), "sig": F.lit(False)})
    return out.unionByName(none)


def bh_values(p: Sequence[float | None]) -> list[float | None]:
    """The same for a handful of values on the driver."""
    order = sorted((i for i, v in enumerate(p) if v is not None), key=lambda i: (p[i], i))
    out: list[float | None] = [None] * len(p)
    low = 1.0
    for j in range(len(order), 0, -1):
        low = min(low, len(order) / j * p[order[j - 1]])
        out[order[j - 1]] = min(1.0, max(0.0, low))
    return out


def benjamini_hochberg_ranged(tests: DataFrame, p: str = "p", order: str = "id", family: Sequence[str] = (), alpha: float = 0.05, ranges: int | None = None) -> DataFrame:
    """``benjamini_hochberg`` of families of any size: no window holds one.

    Rows are cut into ``ranges`` (as many as shuffle partitions) by family, p and
    order at bounds from a sample by hash.  Ranks within a range take the counts
    of the ranges before it, and its running minimum that of the ranges after it,
    from one narrow row for each family and range.  ``tests`` is read once and
    kept with its ranges.
    """
    tests = materialize(tests, "tests")
    n = ranges or max(2, int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = 32
    names = [*family, "__range"]
    at = F.struct(*[F.col(c) for c in (*family, p, order)])
    known = tests.where(F.col(p).isNotNull())
    sample = known.select(at.alias("at")).orderBy(F.xxhash64("at")).limit(every * n)
    bounds = sample.agg(F.sort_array(F.collect_list("at")).alias("all")).select(F.filter("all", lambda x, i: i % every == every - 1).alias("__bounds"))
    cut = known.crossJoin(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= at))).drop("__bounds")
    cut = materialize(cut, "tests-ranges")
    whole = Window.partitionBy(*family)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__m": F.sum("__n").over(whole)})
    own = Window.partitionBy(*names)

    def beside(rows: DataFrame, more: DataFrame) -> DataFrame:
        renamed = more.select(*[F.col(c).alias(f"__of_{c}") for c in names], *[c for c in more.columns if c not in names])
        met = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names]
        return rows.join(renamed, met).drop(*[f"__of_{c}" for c in names])

    ranked = beside(cut, cells.drop("__n")).withColumn("rank", (F.row_number().over(own.orderBy(p, order)) + F.col("__before")).cast("long"))
    ranked = ranked.withColumn("__v", F.col("__m") / F.col("rank") * F.col(p))
    after = whole.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy(*names).agg(F.min("__v").alias("__low")).withColumn("__later", F.min("__low").over(after)).drop("__low")
    down = own.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.min("__v").over(down), F.col("__later"))))
    out = beside(ranked, least).withColumn("q", q).withColumn("sig", F.col("q") <= alpha).select(*tests.columns, "rank", "q", "sig")
    none = tests.where(F.col(p).isNull()).withColumns({"rank": F.lit(None).cast("long"), "q": F.lit(None).cast("double"), "sig": F.lit(False)})
    return out.unionByName(none)
