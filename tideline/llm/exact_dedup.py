"""Operator 10: exact dedup by a log-structured merge index.

1. Each task hashes its documents (SHA-256 of the normalised text) and fills
   memtables of bounded size: digest -> smallest id, count.  A full memtable is
   flushed as a run of level 0: one block, sorted by digest, with a Bloom filter.
2. Compaction, level by level.  ``FAN`` runs of a level become one of the next,
   which is cut by digest into ``FAN`` times as many blocks, so a block has
   about a memtable's entries on every level, and a compaction reads about
   ``FAN`` blocks of one digest range.  A digest that no other block's filter
   may hold bypasses the merge; of the others the smallest identifier and the
   summed count are kept.  Blocks grow in proportion to the rows, and levels
   with the logarithm of the memtables.
3. When ``FAN`` runs are left, the last compaction gives the hits, digests with
   more than one row, their smallest identifier and their count.  They receive
   byte verification: whole normalised texts are told apart under each hit.  A
   hit of one text keeps what the index says; a hit of several, a collision, is
   regrouped by its texts.

A group of copies reaches the compaction as one entry for each memtable.  Rows
under a hit are aggregated by their text.  Where the hits are few enough for a
broadcast that happens in each task, before the shuffle; where they are more,
the texts are first shuffled by digest, which splits a hot one only by Spark's
own skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialize, table, whole_text

MEMTABLE_ROWS = 1 << 17
FAN = 16
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 6
DIGEST_BYTES = 16
#: Null ids come last: they are kept only where no document of the group has an id.
NO_ID = np.iinfo(np.int64).max

BLOCK = "run long, range long, digests binary, ids binary, counts binary, at_least binary, bloom binary"
ENTRY = "digest binary, keep_id long, group_size long, n_least long"


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 16-byte digests: double hashing on their two halves."""
    halves = keys.view("<u8").reshape(-1, 2)
    step = np.arange(BLOOM_PROBES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (halves[:, :1] + step * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def bloom_of(keys: np.ndarray) -> bytes:
    bits = max(64, -(-len(keys) * BLOOM_BITS_PER_KEY // 8) * 8)
    held = np.zeros(bits, np.uint8)
    held[_probes(keys, bits).ravel()] = 1
    return np.packbits(held).tobytes()


def may_hold(bloom: bytes, keys: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bloom, np.uint8))
    return held[_probes(keys, len(held))].all(axis=1)


def _block(run: int, of: int, raw: np.ndarray, entries: np.ndarray) -> dict:
    """A block of entries sorted by digest: ids, counts, and how many of the count have that id."""
    raw = np.ascontiguousarray(raw)
    return {
        "run": run, "range": of, "digests": raw.tobytes(), "ids": entries[:, 0].tobytes(), "counts": entries[:, 1].tobytes(), "at_least": entries[:, 2].tobytes(), "bloom": bloom_of(raw),
    }


def _ranges(raw: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each digest, of ``ranges`` equal ones."""
    lead = raw[:, :4].copy().view(">u4").ravel().astype(np.int64)
    return lead * ranges >> 32


def flush_runs(memtable_rows: int = MEMTABLE_ROWS):
    """A function for mapInPandas: rows ``digest, doc_id`` to the blocks of runs, one a memtable."""

    def flush(memtable: dict, run: int) -> pd.DataFrame:
        keys = sorted(memtable)
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, DIGEST_BYTES)
        return pd.DataFrame([_block(run, 0, raw, np.array([memtable[k] for k in keys], np.int64).reshape(-1, 3))])

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, flushed, memtable = TaskContext.get().partitionId() << 24, 0, {}
        for batch in batches:
            for digest, doc_id in zip(batch["digest"], batch["doc_id"], strict=True):
                held = memtable.get(digest)
                if held is None:
                    if len(memtable) >= memtable_rows:
                        yield flush(memtable, task + flushed)
                        memtable, flushed = {}, flushed + 1
                    memtable[digest] = [doc_id, 1, 1]
                else:
                    held[1] += 1
                    if doc_id < held[0]:
                        held[0], held[2] = doc_id, 1
                    elif doc_id == held[0]:
                        held[2] += 1
        if memtable:
            yield flush(memtable, task + flushed)

    return run_task


def _merged(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Digests and entries of blocks of one range, sorted and each digest once."""
    keys = [np.frombuffer(x, np.uint8).reshape(-1, DIGEST_BYTES) for x in blocks["digests"]]
    entries = [np.stack([np.frombuffer(x, np.int64) for x in row], 1) for row in zip(blocks["ids"], blocks["counts"], blocks["at_least"], strict=True)]
    alone, go = [], []
    for i, own in enumerate(keys):
        elsewhere = np.zeros(len(own), bool)
        for j, bloom in enumerate(blocks["bloom"]):
            if j != i and not elsewhere.all():
                rest = np.flatnonzero(~elsewhere)
                elsewhere[rest] = may_hold(bloom, np.ascontiguousarray(own[rest]))
        alone.append((own[~elsewhere], entries[i][~elsewhere]))
        go.append((own[elsewhere], entries[i][elsewhere]))
    raw = np.ascontiguousarray(np.concatenate([k for k, _ in go]))
    values = np.concatenate([e for _, e in go])
    order = _order(raw, values[:, 0])
    raw, values = raw[order], values[order]
    if len(raw):
        new = np.r_[True, (raw[1:] != raw[:-1]).any(axis=1)]
        starts = np.flatnonzero(new)
        least = values[starts, 0]
        group = np.cumsum(new) - 1
        n_least = np.bincount(group, np.where(values[:, 0] == least[group], values[:, 2], 0), len(starts)).astype(np.int64)
        raw, values = raw[starts], np.stack([least, np.add.reduceat(values[:, 1], starts), n_least], 1)
    raw = np.concatenate([raw, *(k for k, _ in alone)])
    values = np.concatenate([values, *(e for _, e in alone)])
    order = _order(raw, values[:, 0])
    return raw[order], values[order]


def _order(raw: np.ndarray, ids: np.ndarray) -> np.ndarray:
    key = np.ascontiguousarray(raw).view([("a", ">u8"), ("b", ">u8")]).ravel()
    return np.lexsort((ids, key["b"], key["a"]))


def compact(ranges: int):
    """A function for applyInPandas: the blocks of one range of a group of runs to blocks of one run, cut into ``ranges`` ranges."""

    def run_group(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        raw, entries = _merged(blocks)
        of = _ranges(raw, ranges)
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        return pd.DataFrame([_block(int(key[0]), int(of[a]), raw[a:b], entries[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return run_group


def hits(blocks: pd.DataFrame) -> pd.DataFrame:
    """The digests of more than one row among the blocks of one range."""
    raw, entries = _merged(blocks)
    many = entries[:, 1] > 1
    return pd.DataFrame({"digest": [x.tobytes() for x in raw[many]], "keep_id": entries[many, 0], "group_size": entries[many, 1], "n_least": entries[many, 2]})


def normalised(text_col: str = "text"):
    return F.regexp_replace(whole_text(text_col), f"[{SPACE}]+", " ")


def _index_key(sha, digest_bytes: int):
    """The index key: the leading bytes of the digest, spread over 16 bytes where fewer are asked for (tests provoke collisions so)."""
    if digest_bytes >= DIGEST_BYTES:
        return F.unhex(F.substring(sha, 1, 2 * DIGEST_BYTES))
    return F.unhex(F.substring(F.sha2(F.substring(sha, 1, 2 * digest_bytes), 256), 1, 2 * DIGEST_BYTES))


def merge_index(keyed: DataFrame, memtable_rows: int = MEMTABLE_ROWS, fan: int = FAN, levels: list[int] | None = None) -> DataFrame:
    """``digest, keep_id, group_size, n_least`` of the digests that more than one row of ``keyed`` has.

    ``levels``, where it is given, receives the number of blocks of each level.
    """
    # Whole numbers without nulls, which stay whole in a task.
    named = keyed.select("digest", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"))
    blocks = materialize(named.mapInPandas(flush_runs(memtable_rows), BLOCK), "dedup-run-0")
    runs, ranges, level = blocks.count(), 1, 0
    seen = [runs]
    while runs > fan:
        runs, ranges, level = -(-runs // fan), ranges * fan, level + 1
        # The runs of level 0 are named by their tasks; from then on they are numbered.
        into = F.pmod(F.xxhash64("run"), F.lit(runs)) if level == 1 else F.floor(F.col("run") / fan)
        merged = blocks.withColumn("into", into.cast("long")).groupBy("into", "range").applyInPandas(compact(ranges), BLOCK)
        blocks = materialize(merged, f"dedup-run-{level}")
        seen.append(blocks.count())
    if levels is not None:
        levels += seen
    return blocks.groupBy("range").applyInPandas(hits, ENTRY)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row of ``docs``.

    Null texts count as empty, so they are copies of each other and of empty
    texts.  Null ids come after all others.  Of repeated rows with the smallest
    id of a group exactly one is kept.  Other columns are not read; an empty
    table gives no rows.
    """
    sha = F.sha2(F.col("norm"), 256)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm")).withColumn("sha", sha).withColumn("digest", _index_key(F.col("sha"), digest_bytes))
    # The tag tells rows of one id apart.
    keyed = materialize(whole.select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("tag")), "dedup-digests")
    found = materialize(merge_index(keyed, memtable_rows), "dedup-hits")
    order = F.coalesce("doc_id", F.lit(int(NO_ID)))
    under = whole.join(found.select("digest"), "digest", "left_semi").groupBy("digest", "norm", "sha").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("n"))
    texts = materialize(under.drop("norm"), "dedup-texts")
    collided = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-collisions")
    sure = found.join(collided, "digest", "left_anti").select(F.col("digest").alias("of"), F.col("keep_id").alias("keep"), F.col("group_size").alias("n"), F.col("n_least").alias("least"))
    split = texts.join(collided, "digest", "left_semi").select(F.col("sha").alias("of_sha"), F.col("keep").alias("split_keep"), F.col("n").alias("split_n"))
    beside = keyed.join(sure, F.col("digest") == F.col("of"), "left").join(split, F.col("sha") == F.col("of_sha"), "left")
    keep, n = F.coalesce("keep", "split_keep"), F.coalesce("n", "split_n")
    keep_id = F.when(n.isNull(), F.col("doc_id")).when(keep != int(NO_ID), keep)
    marked = beside.select("doc_id", keep_id.alias("keep_id"), F.coalesce(n, F.lit(1)).cast("long").alias("group_size"), "sha", "tag", (F.coalesce("least", F.when(n.isNull(), 1).otherwise(2)) > 1).alias("tied"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if found.where("n_least > 1").isEmpty() and collided.isEmpty():
        return marked.select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("sha").alias("text_sha256"))
    # Several rows can share the smallest id; the first of them stays.
    marked = materialize(marked, "dedup-tied")
    chosen = marked.where(F.col("tied") & first).groupBy("sha").agg(F.min("tag").alias("first_tag")).withColumnRenamed("sha", "of")
    kept = first & (~F.col("tied") | (F.col("tag") == F.col("first_tag")))
    return marked.join(chosen, F.col("sha") == F.col("of"), "left").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the smallest id, of repeated rows one.

    What goes is far less than what stays, so rows are joined against what goes,
    by a shuffle at every size, as what goes grows with the documents.
    Null texts count as empty, null ids come last; rows that repeat both id and
    text count as one row, whatever their other columns hold, and any of them
    stays.  An empty table stays empty.
    """
    marked = materialize(exact_duplicates(docs), "dedup-marked")
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    gone = materialize(named(marked.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))), "dedup-gone")
    # Rows that repeat the id and text of the one that stays.
    repeats = materialize(named(marked.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept"))), "dedup-repeats")
    own = free_name(docs, "__own")
    hashed = docs.withColumn(own, F.sha2(normalised(), 256))
    same = lambda other: hashed["doc_id"].cast("long").eqNullSafe(other["__id"]) & (hashed[own] == other["__sha"])
    stay = hashed.join(gone.hint("shuffle_hash"), same(gone), "left_anti")
    if repeats.isEmpty():
        return stay.drop(own)
    once = hashed.join(repeats, same(repeats), "left_semi").dropDuplicates(["doc_id", own])
    return stay.join(repeats, same(repeats), "left_anti").unionByName(once).drop(own)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
r AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS nth FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, nth = 1 AS kept, text_sha256 FROM r
"""
