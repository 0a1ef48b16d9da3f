"""Operator 12: vectors as short codes, one codebook entry for each part.

Integer vectors are cut into parts.  Each part has a small codebook, moved by
rounds of nearest-entry means.  The nearest entry is found by segment means from
coarse to fine: of blocks of a part, the difference of means and the difference
of residual norms bound the squared distance from below,

    |x - e|^2 >= sum over blocks of len * (mean x - mean e)^2 + (|res x| - |res e|)^2,

so an entry whose bound is above the exact distance of another one is left out.
The bounds are lowered by more than their rounding error, and what survives the
finest blocks gets its exact integer distance.

A round is one pass: every task sends sums and counts of each entry, and the
driver holds the codebooks alone, whose size the parameters fix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import LONG_MAX, magnitude, matrix, scaled_floors, to_long, whole

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Blocks of a part at each level of the bounds.
LEVELS = (1, 2, 4)
#: Share of a bound that rounding can't reach.
SLACK = 1e-9
#: Labels that hold more than one row in this many are met by a broadcast: there are fewer than this many.
HOT_LABELS = 1000
_ROWS = 8192


class Summaries:
    """Block means and residual norms of integer rows at each level."""

    def __init__(self, rows: np.ndarray):
        real = rows.astype(float)
        self.square = (real * real).sum(axis=1)
        self.levels = []
        for blocks in LEVELS:
            edges = np.linspace(0, rows.shape[1], min(blocks, max(1, rows.shape[1])) + 1).astype(int)
            sizes = np.diff(edges)
            means = np.stack([real[:, a:b].mean(axis=1) if b > a else np.zeros(len(rows)) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)
            left = real - np.repeat(means, sizes, axis=1)
            self.levels.append((sizes, means, np.sqrt((left * left).sum(axis=1))))


def exact_distance(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """Squared distances of integer rows; in Python's integers where a long could overflow."""
    wide = 4 * largest * largest * max(1, a.shape[1]) >= 1 << 62
    d = a.astype(object) - b.astype(object) if wide else a - b
    return (d * d).sum(axis=1) if d.shape[1] else np.zeros(len(d), object if wide else np.int64)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (the first of equally near ones), its squared distance, and how many exact distances that took."""
    n, k = len(rows), len(book)
    largest = max(magnitude(rows), magnitude(book))
    x, e = Summaries(rows), Summaries(book)
    slack = SLACK * (x.square[:, None] + e.square[None]) + 1e-6
    alive = np.ones((n, k), bool)
    every = np.arange(n)
    known: np.ndarray | None = None
    for (sizes, mx, rx), (_, me, re) in zip(x.levels, e.levels, strict=True):
        r, c = np.nonzero(alive)
        d = mx[r] - me[c]
        low = np.full((n, k), np.inf)
        low[r, c] = (d * d) @ sizes + (rx[r] - re[c]) ** 2 - slack[r, c]
        # The most promising entry's exact distance is the limit; the last level's is no worse a guess.
        guess = low.argmin(axis=1)
        limit = exact_distance(rows, book[guess], largest)
        known = limit if known is None else np.minimum(known, limit)
        alive &= low <= known.astype(float)[:, None] * (1 + SLACK)
    r, c = np.nonzero(alive)
    found = exact_distance(rows[r], book[c], largest)
    # Rows of one vector lie together, entries rise: the first least one of each.
    starts = np.searchsorted(r, every)
    least = np.minimum.reduceat(found, starts) if len(found) else found
    hit = np.flatnonzero(found == least[r])
    first = hit[np.searchsorted(r[hit], every)]
    return c[first], least, len(found) + n * len(LEVELS)


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances, (vectors, parts), by codebooks (parts, entries, width)."""
    width = books.shape[2]
    found = [nearest(vectors[:, p * width : (p + 1) * width], book)[:2] for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def entry_sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, place, total, n``: the sums of what each entry is nearest to."""
    parts, entries, width = books.shape

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in batches:
            for a in range(0, len(batch), _ROWS):
                v = matrix(batch["ints"].iloc[a : a + _ROWS], parts * width)
                codes, _ = assign(v, books)
                wide = magnitude(v) * len(v) >= 1 << 62
                for p in range(parts):
                    own = v[:, p * width : (p + 1) * width]
                    for e in np.unique(codes[:, p]):
                        of = own[codes[:, p] == e]
                        total = (of.astype(object) if wide else of).sum(axis=0)
                        out += [(p, int(e), w, Decimal(int(t)), len(of)) for w, t in enumerate(total)]
            yield pd.DataFrame(out, columns=["part", "entry", "place", "total", "n"])
            out = []

    sums = kept.select("ints").mapInPandas(run_task, "part int, entry int, place int, total decimal(38,0), n long")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))


def moved(books: np.ndarray, kept: DataFrame) -> np.ndarray:
    """The codebooks after a round; an entry that nothing is nearest to stays."""
    out = books.copy()
    for r in entry_sums(kept, books).collect():  # parts * entries * width rows
        out[r["part"], r["entry"], r["place"]] = to_long(int(r["total"]) // r["n"])
    return out


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) for rows ``vec_id, ints``; they start as the vectors of the smallest ids."""
    longest = kept.agg(F.max(F.size("ints"))).first()[0] or 0
    width = -(-longest // parts)
    seeds = [r["ints"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()]
    books = matrix(seeds, parts * width).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if seeds else 0):
        books = moved(books, kept)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of ``vec_id, label, ints``."""
    parts, _, width = books.shape
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"

    def run_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("ints")
            codes, errors = [], []
            for a in range(0, batch.num_rows, _ROWS):
                code, error = assign(matrix([x.values.to_numpy() for x in lists[a : a + _ROWS]], parts * width), books)
                codes += [row.tobytes().hex() for row in code.astype(np.uint8)]
                errors += [to_long(sum(map(int, row))) for row in error]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "ints").mapInArrow(run_task, schema)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row whose vector is whole.

    Vectors that are null or hold null or non-finite components are dropped.
    Null ids come last in the choice of the first entries, equal ids go by their
    components.  A shorter vector counts as ending in zeros, as do all where the
    length is no multiple of the parts.  Fewer vectors than entries make shorter
    codebooks.  Components, errors and sums beyond the range of a long are held
    to it.  Rows of null label are one group.  Other columns are not read; an
    empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit two hex digits")
    rows = vectors.where(whole(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), scaled_floors(vector_col, SCALE).alias("ints"))
    kept = materialize(rows, "codes-vectors")
    books = train_codebooks(kept, parts, entries, rounds)
    coded = materialize(encode(kept, books), "codes-errors")
    held = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    totals = materialize(coded.groupBy("label").agg(held("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels").withColumnRenamed("label", "of")
    limit = coded.count() // HOT_LABELS
    alike = F.col("label").eqNullSafe(F.col("of"))
    # Fewer than HOT_LABELS labels can hold so many rows each.
    hot = coded.join(F.broadcast(totals.where(F.col("n") > limit)), alike, "left")
    found = ["vec_id", "code", "error", "label_error"]
    rest = hot.where("label_error IS NULL").select("vec_id", "label", "code", "error").join(totals.where(F.col("n") <= limit), alike)
    return hot.where("label_error IS NOT NULL").select(*found).unionByName(rest.select(*found)).withColumn("codebooks_sha256", F.lit(book_digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round is two steps: distances to the entries before it, then means of what is nearest."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"w AS (SELECT (max(len(e)) + {PARTS - 1}) // {PARTS} AS w FROM v)",
        f"p AS MATERIALIZED (SELECT r, CAST(part AS INTEGER) AS part, list_transform(range(0, w), lambda k: coalesce(e[part * w + k + 1], 0)) AS x FROM v, w, range(0, {PARTS}) AS t(part))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS entry FROM v QUALIFY entry < {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT part, entry, x AS y FROM p JOIN s USING (r))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""n{k} AS MATERIALIZED (SELECT r, part, x, (min(({{'d': d, 'entry': entry}}))).d AS d, (min(({{'d': d, 'entry': entry}}))).entry AS entry FROM (
  SELECT r, p.part, x, entry, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - y[k]) * (x[k] - y[k]))) AS BIGINT) AS d FROM p JOIN b{k} b ON p.part = b.part) GROUP BY r, part, x)"""
        )
        if k < ROUNDS:
            steps.append(f"""u{k} AS (SELECT part, entry, k, CAST(sum(x[k]) AS BIGINT) AS total, count(*) AS n FROM n{k}, range(1, 1 + (SELECT w FROM w)) AS t(k) GROUP BY part, entry, k)""")
            steps.append(f"""m{k} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY k) AS y FROM u{k} GROUP BY part, entry)""")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)")
    steps += [
        f"c AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (r), h"


SQL = _sql()
