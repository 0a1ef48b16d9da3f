"""Row numbers, running sums and row windows of entities too long for one task.

Rows are dealt by ranges of entity and order, and the deal is written down.
Numbers and sums are made within a range; what the ranges before it hold is one
row a range and entity.  Windows of rows work on chunks of equal length, each
with a halo of the rows that its frames reach into.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import materialize

NONE: Sequence[str] = ()
#: Rows of a chunk.
CHUNK = 65_536
Frame = Callable[[int, int], WindowSpec]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where the frame has such a column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def beside(rows: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join by columns that both have and that may be null."""
    names = {c: f"{c}__of" for c in on}
    right = other.withColumnsRenamed(names)
    alike = F.lit(True)
    for c, n in names.items():
        alike = alike & F.col(c).eqNullSafe(F.col(n))
    return rows.join(right, alike, "left").drop(*names.values())


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str = "n", sums: dict[str, Column] | None = None, label: str = "ranges") -> DataFrame:
    """``df`` with the number of each row in its entity, from 1, and the sums of the rows before it.

    The order should tell an entity's rows apart; of rows that it doesn't any
    comes first.  Nulls in a sum count as zero.
    """
    sums = sums or {}
    part = free_name(df, "__part")
    values = {n: free_name(df, f"__{n}") for n in sums}
    cut = df.withColumns({v: sums[n] for n, v in values.items()}).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    held = materialize(cut, label)
    within = Window.partitionBy(*keys, part)
    earlier = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumns({number: F.row_number().over(within.orderBy(*order)).cast("long")} | {n: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for n, v in values.items()})
    totals = held.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(v).alias(f"__sum_{n}") for n, v in values.items()])
    # A row for each range and entity.
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, part, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in ("__rows", *[f"__sum_{n}" for n in values])])
    added = {number: F.col(number) + F.col("__before___rows")} | {n: F.col(n) + F.col(f"__before___sum_{n}") for n in values}
    return beside(local, starts, [*keys, part]).withColumns(added).select(*df.columns, number, *values)


def over_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: dict[str, Callable[[Frame], Column]], back: int, ahead: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``df`` with window columns: each is made with a function from the first and last row of a frame, relative to the row, to its window.

    Frames reach no further than ``back`` rows before and ``ahead`` rows after a
    row.  Equal to plain windows over ``keys``, with an entity's rows in as many
    tasks as it has chunks.
    """
    chunk = max(chunk, back, ahead, 1)
    number, piece, own = (free_name(df, c) for c in ("__number", "__piece", "__own"))
    rows = running(df, keys, order, number)
    home = F.floor((F.col(number) - 1) / chunk)
    at = F.col(number) - 1 - home * chunk
    places = F.concat(
        F.array(F.struct(home.alias("p"), F.lit(True).alias("o"))),
        F.when(at >= chunk - back, F.array(F.struct((home + 1).alias("p"), F.lit(False).alias("o")))).otherwise(F.array()),
        F.when(at < ahead, F.array(F.struct((home - 1).alias("p"), F.lit(False).alias("o")))).otherwise(F.array()),
    )
    spread = rows.withColumn(piece, F.explode(places)).withColumns({own: F.col(piece)["o"], piece: F.col(piece)["p"]})

    def frame(start: int, end: int) -> WindowSpec:
        return Window.partitionBy(*keys, piece).orderBy(number).rowsBetween(start, end)

    return spread.withColumns({name: f(frame) for name, f in make.items()}).where(own).drop(number, piece, own)
