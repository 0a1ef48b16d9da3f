"""Operator 11: exact top-k inner products by the threshold algorithm.

Candidates are dealt into blocks.  A block keeps, for every dimension, a list of
its candidates sorted by that component; a query reads the lists from the end
that its own component's sign favours, all to the same depth, and scores each
candidate that it meets for the first time.  No candidate that is still unseen
can score above the sum of the query's products with the components last read.
As soon as that bound is below the k-th score found, the block is done.

Queries are dealt into blocks too, and every query block meets every candidate
block.  That happens in rounds of ``GROWTH`` times as many candidate blocks: a
query takes the k-th score of the rounds before it into the next, so a block
stops at once where it has nothing better, and returns no row below that score.
So a query's rows stay near ``k * GROWTH`` a round, and the rounds are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import magnitude, matrix, scaled_floors, to_long, whole

SCALE = 1024
EVERY = 100
TOP = 10
#: Rows of a block of candidates, and of queries.
CANDIDATES = 4096
QUERIES = 8192
GROWTH = 8
#: Entries read from each list at first; every further turn reads twice as many.
DEPTH = 16
NO_ID = (1 << 63) - 1
#: Sums below this are exact in double precision.
_EXACT = 1 << 53

_FOUND = "query long, score long, row long, vec_id long"


class Block:
    """The sorted lists of a block of candidates: ``vectors`` are integers, a row each."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.width = vectors.shape[1]
        up = np.argsort(vectors.T, axis=1, kind="stable")
        #: Lists from the smallest component up, then from the largest down.
        self.lists = np.concatenate([up, up[:, ::-1]])
        self.values = np.take_along_axis(np.concatenate([vectors.T, vectors.T]), self.lists, axis=1)
        self.largest = magnitude(vectors)
        self.real = vectors.astype(float)

    def best(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int, int]]:
        """``(score, vec_id, row)`` of the k best candidates other than the row ``own``, leaving out scores below ``least``.

        Higher scores come first, then smaller ids, then earlier rows.
        """
        n = len(self.ids)
        used = np.flatnonzero(query)
        exact = magnitude(query) * self.largest * max(1, self.width) < _EXACT
        vectors, q = (self.real, query.astype(float)) if exact else (self.vectors.astype(object), query.astype(object))
        lists = np.where(query[used] > 0, self.width + used, used)
        seen = np.zeros(n, bool)
        found: list[tuple[int, int, int]] = []
        start, step = 0, DEPTH
        while start < n:
            end = min(n, start + step)
            met = np.zeros(n, bool)
            if len(used):
                met[self.lists[lists, start:end]] = True
            else:
                met[:] = True
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met & (self.rows != own))
            scores = vectors[new] @ q
            floor = found[k - 1][0] if len(found) >= k else least
            if floor is not None:
                high = np.asarray(scores >= floor, bool)
                new, scores = new[high], scores[high]
            if len(new) > k:  # those below the k-th of this turn can't stay
                kth = np.sort(scores)[len(scores) - k]
                high = np.asarray(scores >= kth, bool)
                new, scores = new[high], scores[high]
            more = [(to_long(s), int(self.ids[i]), int(self.rows[i])) for s, i in zip(scores, new, strict=True)]
            if more:
                found = sorted(found + more, key=lambda x: (-x[0], x[1], x[2]))[: max(k, 0)]
            if not len(used) or seen.all():
                break
            bound = int(sum(int(a) * int(b) for a, b in zip(query[used], self.values[lists, end - 1], strict=True)))
            floor = found[k - 1][0] if len(found) >= k else least
            if floor is not None and bound < floor:
                break
            start, step = end, 2 * step
        return found


def search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows of ``_FOUND`` for ``vec_id, row, ints`` and ``vec_id, row, ints, least``."""
    out: list[tuple[int, int, int, int]] = []
    if len(candidates) and len(queries):
        width = max(max(map(len, candidates["ints"])), max(map(len, queries["ints"])))
        block = Block(matrix(candidates["ints"], width), candidates["vec_id"].to_numpy(np.int64), candidates["row"].to_numpy(np.int64))
        asked = matrix(queries["ints"], width)
        for q, own, least in zip(asked, queries["row"], queries["least"], strict=True):
            out += [(own, s, row, i) for s, i, row in block.best(q, own, k, None if pd.isna(least) else int(least))]
    return pd.DataFrame(out, columns=["query", "score", "row", "vec_id"])


def top_scores(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each row whose id is divisible by ``every`` with all other rows.

    Vectors that are null or hold null or non-finite components take no part.
    Each row is a vector of its own: a repeated row is a candidate of its twin,
    and a second query where its id makes it one.  A null id is never a query
    and, among equal scores, the last; equal ids go by the order of the kept
    rows.  A shorter vector counts as ending in zeros.  Components and scores
    beyond the range of a long are held to it.  Other columns are not read; an
    empty table gives no rows.
    """
    rows = vectors.where(whole(vector_col)).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(id_col).isNull().alias("nameless"), scaled_floors(vector_col, SCALE).alias("ints"))
    kept = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asking = materialize(kept.where(~F.col("nameless") & (F.col("vec_id") % every == 0)), "topk-queries")
    count, asked = kept.count(), asking.count()
    blocks, asking_blocks = max(1, -(-count // candidates)), max(1, -(-asked // queries))
    # Row numbers rise within a task, so blocks are dealt by a hash of them.
    dealt = kept.select("vec_id", "row", "ints", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    asking = asking.select("vec_id", "row", "ints", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(asking_blocks)).cast("int").alias("part"))

    best: DataFrame | None = None
    first = 0
    while first < blocks:
        last = min(blocks, max(1, first * GROWTH))
        if best is None:
            floors = asking.withColumn("least", F.lit(None).cast("long"))
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query").alias("of"), F.col("score").alias("least"))
            floors = asking.join(kth, F.col("row") == F.col("of"), "left").drop("of")
        here = dealt.where((F.col("block") >= first) & (F.col("block") < last))
        here = here.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asking_blocks - 1))))
        there = floors.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        found = here.groupBy("block", "part").cogroup(there.groupBy("block", "part")).applyInPandas(lambda a, b: search(a, b, k), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = materialize(ranked(found, k), f"topk-{first}")
        first = last
    names = kept.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    shown = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return best.join(names, "query").select("query_id", "rank", shown.alias("vec_id"), "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query of ``_FOUND`` with their rank."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_scores(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0),
t AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= {TOP}
"""
