"""Operator 7: SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions.  Two fingerprints that
differ in at most ``MAX_BITS`` = 2 bits differ in at most two bytes, so they
share at least six positional bytes: the guaranteed minimum of the count filter.

1. Postings.  Those of a single positional byte would hold 1/256 of all
   fingerprints each, so positional bytes are posted ``KEY_BYTES`` = 5 at a
   time: 56 sets of positions, each with its five bytes.  A pair that shares
   six bytes meets in 6 postings, one that shares seven in 21, one that shares
   five in a single one.
2. Tally.  The pairs of every posting of up to ``FEW`` members are counted, and
   those with the guaranteed number of meetings are kept.
3. A larger posting (a cluster of near copies) yields no pairs.  Its members
   are posted again by the 28 sets of six positions; a posting then leaves two
   bytes free, so it has at most 65,536 members, and gives the links of a
   spanning forest.  A pair that shares six bytes either meets in such a
   posting at least once, and is found here, or in six small ones.
4. Verification by the number of differing bits.

Equal fingerprints are one entry of the index; the components of all links come
from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, table, whole_text

WORDS = 3
MAX_BITS = 2
KEY_BYTES = 5
FEW = 16
SEED = 42
HASH_CHUNK = 1 << 16
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = regex.compile(f"[^{SPACE}]+")
_POPCOUNT16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of one whole text; zero where it has no words."""
    w = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, n, HASH_CHUNK):
        shingles = [" ".join(w[i : i + words]) for i in range(a, min(n, a + HASH_CHUNK))]
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long."""

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(run_task, "doc_id long, fp long")


def _union_find(pairs: np.ndarray, n: int) -> np.ndarray:
    """Component roots (smallest member) of n items under index pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return root


def posting_links(free: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Links of a spanning forest of the verified pairs of one posting.

    ``free`` holds its members' two free bytes, distinct and sorted.  A small
    posting compares its members; a large one looks up the values that differ in
    one or two bits, so work stays in proportion to its members.
    """
    n = len(free)
    if n <= 64:
        i, j = np.nonzero(np.triu(_POPCOUNT16[free[:, None] ^ free[None, :]] <= max_bits, 1))
        pairs = np.stack([i, j], 1)
    else:
        at = np.full(1 << 16, -1, np.int32)
        at[free] = np.arange(n)
        bits = [1 << b for b in range(16)]
        masks = [m for k in range(1, max_bits + 1) for c in combinations(bits, k) for m in [reduce(int.__or__, c)]]
        found = [np.stack([np.arange(n), at[free ^ m]], 1) for m in masks]
        pairs = np.concatenate([f[f[:, 1] > f[:, 0]] for f in found])
    if not len(pairs):
        return pairs
    root = _union_find(pairs, n)
    member = np.flatnonzero(root != np.arange(n))
    return np.stack([member, root[member]], 1)


def _posted(prints: DataFrame, size: int) -> DataFrame:
    """``at, rest, fp``: each fingerprint under every set of ``size`` positions (``at`` is its number, ``rest`` has its bytes)."""
    keys = []
    for number, places in enumerate(combinations(range(8), size)):
        mask = np.uint64(sum(0xFF << 8 * p for p in places)).astype(np.int64)
        keys.append(F.struct(F.lit(number).cast("byte").alias("at"), F.col("fp").bitwiseAND(F.lit(int(mask))).alias("rest")))
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.at", "k.rest", "fp")


def tallied_links(shared: DataFrame, max_bits: int) -> DataFrame:
    """``u, v`` of the pairs that meet often enough in the postings ``at, rest, fp`` and are verified."""
    a, b = (shared.select("at", "rest", F.col("fp").alias(name)) for name in "uv")
    tally = a.join(b, ["at", "rest"]).where("u > v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("meetings"))
    return tally.where(F.col("meetings") >= comb(8 - max_bits, KEY_BYTES)).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")


def split_links(members: DataFrame, max_bits: int) -> DataFrame:
    """``u, v``: a spanning forest of the verified pairs of each posting of six positions of ``fp``."""
    held = [p for p in combinations(range(8), 6)]
    free_at = [sorted(set(range(8)) - set(p)) for p in held]

    def byte(k: int):
        return F.element_at(F.array(*[F.shiftrightunsigned("fp", 8 * free[k]).bitwiseAND(0xFF) for free in free_at]), F.col("at").cast("int") + 1)

    free = F.shiftleft(byte(1), 8).bitwiseOR(byte(0)).cast("int")
    postings = _posted(members, 6).groupBy("at", "rest").agg(F.collect_list(free).alias("free")).where(F.size("free") > 1)

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs = [], []
            for at, rest, values in zip(batch["at"], batch["rest"], batch["free"], strict=True):
                own = np.sort(np.asarray(values, np.int64))
                links = posting_links(own, max_bits)
                if len(links):
                    low, high = (np.uint64(8 * p) for p in free_at[at])
                    u = own.astype(np.uint64)
                    whole = (np.uint64(int(rest) & (1 << 64) - 1) | ((u & np.uint64(0xFF)) << low) | ((u >> np.uint64(8)) << high)).view(np.int64)
                    us.append(whole[links[:, 0]])
                    vs.append(whole[links[:, 1]])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return postings.mapInPandas(run_task, "u long, v long")


def index_links(prints: DataFrame, max_bits: int = MAX_BITS, few: int = FEW) -> DataFrame:
    """``u, v``: links between the distinct fingerprints ``fp`` that reach as far as all pairs of up to ``max_bits`` differing bits do."""
    if not 1 <= max_bits <= 2:
        raise ValueError("five shared positions are guaranteed to be met for one or two differing bits")
    # The explode needs tasks of its own: the table of fingerprints is a few small files.
    dealt = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    members = F.count(F.lit(1)).over(Window.partitionBy("at", "rest"))
    shared = materialize(_posted(dealt, KEY_BYTES).withColumn("members", members).where("members > 1"), "simhash-postings")
    tallied = tallied_links(shared.where(F.col("members") <= few), max_bits)
    return tallied.unionByName(split_links(shared.where(F.col("members") > few).select("fp").distinct(), max_bits))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable over ``u, v``, for every node that is not its own root.

    Large-star and small-star steps alternate until the links are stars around
    the smallest nodes.  Minima are aggregated map-side, so a hub is not
    gathered anywhere.  Each round is a written table.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links-0")
    before, step = None, 0
    while True:
        step += 1
        # Large star: every node's larger neighbours go to the least node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, f"links-{step}")
        # A settled round repeats itself.
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; texts of
    fewer than ``words`` words are one shingle.  A null id gets a row and joins
    its component, but is never the smallest id (a component of null ids alone
    has a null component_id).  Other columns are not read.
    """
    printed = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(index_links(classes.select("fp"), max_bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(smallest, "root").select(F.col("fp").alias("of"), "component_id"), "simhash-components")
    return printed.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose id isn't their component's smallest, with their columns.

    What goes is far less than what stays, so the rows are joined against the
    ids that go.  Rows of one id count as one document; rows without an id stay.
    """
    found = near_duplicates(docs, **settings)
    gone = materialize(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct(), "simhash-gone")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
