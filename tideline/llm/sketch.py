"""Operator 3: document fingerprints as invertible Bloom lookup sketches.

A text is its paragraphs (lines), cut by content: a piece ends after a word whose
hash says so, one word in ``PIECE_WORDS``, so words put in or left out change the
pieces around them and no others.  Every piece has a 64-bit digest, a repeated
piece one for each time it occurs.  A sketch adds each digest to three cells, one in each third: a count, a
sum of digests and a sum of check hashes.  Cells of two versions subtract; what
both hold cancels, and peeling recovers the digests that only one of them has:
a cell with count 1 or -1 whose check agrees names a digest, which then leaves
its other cells.  Where peeling gets stuck, both sketches are built anew with
twice the cells, and where that doesn't help (two pieces of one digest), with
other digests.  Likeness is Dice's: twice the shared pieces over all.

Documents are dealt by range of their ids and sorted, so a document meets the
next one within its task; only the first and last document of each task are
paired afterwards, by task number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, whole_text

PIECE_WORDS = 8
CELLS = 12
GROWTH = 2
#: Added to the seeds of the digests where two pieces had the same.
SALT = 1 << 32

ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: A number for each byte; the sum of a word's, times an odd number, is its hash.
_BYTES = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - PIECE_WORDS.bit_length() + 1)


def pieces(text: str) -> list[bytes]:
    """The pieces of a text in UTF-8: lines, cut at the spaces that follow words of a certain hash."""
    raw = text.encode("utf-8")
    b = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero((b == 32) | (b == 10))
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(b)]
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b], out=upto[1:])
    last = (upto[ends] - upto[starts]) * _TIMES >> _TOP == 0
    last[:-1] |= b[gaps] == 10
    last[-1] = True
    at = np.flatnonzero(last)
    first = starts[np.r_[0, at[:-1] + 1]]
    return [raw[x:y] for x, y in zip(first.tolist(), ends[at].tolist(), strict=True) if x < y]


def digests(text: str, salt: int = 0) -> np.ndarray:
    """The digests of all pieces; the n-th occurrence of a piece has its own."""
    seen: dict[bytes, int] = {}
    out = []
    for p in pieces(text):
        n = seen.get(p, 0)
        seen[p] = n + 1
        out.append(xxhash.xxh64_intdigest(p, n + salt))
    return np.array(out, np.uint64)


_FIELDS = np.array([[0], [21], [42]], np.uint64)
_FIELD = np.uint64((1 << 21) - 1)
_THIRDS = np.arange(3)[:, None]


def _cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The three cells of each digest, (3, n): as digests are uniform, their bit fields choose them."""
    return ((keys >> _FIELDS & _FIELD) % np.uint64(size // 3)).astype(np.int64) + _THIRDS * (size // 3)


def _check(keys: np.ndarray) -> np.ndarray:
    """A check hash that isn't linear, so that sums of digests don't pass for one."""
    x = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


class Sketch:
    """Counts, digest sums and check sums of ``size`` cells (a multiple of three)."""

    def __init__(self, keys: np.ndarray, check: np.ndarray, size: int = CELLS):
        self.n, self.size = len(keys), size
        at = _cells(keys, size).ravel()
        self.count = np.bincount(at, minlength=size)
        self.keys = np.zeros(size, np.uint64)
        self.check = np.zeros(size, np.uint64)
        np.add.at(self.keys, at, np.concatenate([keys, keys, keys]))
        np.add.at(self.check, at, np.concatenate([check, check, check]))

    def text(self) -> str:
        """The fingerprint as text: the number of pieces and the cells."""
        raw = self.count.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.check.astype("<u4").tobytes()
        return f"{self.n}:{base64.b64encode(raw).decode()}"

    def difference(self, other: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests that only this and only the other sketch hold, or None where peeling gets stuck."""
        count, keys, check = self.count - other.count, self.keys - other.keys, self.check - other.check
        mine, theirs = [], []
        while True:
            single = np.flatnonzero((count == 1) | (count == -1))
            if not len(single):
                break
            sign = count[single]
            unsigned = sign.astype(np.uint64)
            key = keys[single] * unsigned
            hashed = _check(key)
            pure = np.flatnonzero(check[single] * unsigned == hashed)
            key, first = np.unique(key[pure], return_index=True)
            if not len(key):
                break
            pure = pure[first]
            sign, unsigned, hashed = sign[pure], unsigned[pure], hashed[pure]
            mine.append(key[sign > 0])
            theirs.append(key[sign < 0])
            at, key, hashed = _cells(key, self.size).ravel(), key * unsigned, hashed * unsigned
            np.subtract.at(count, at, np.concatenate([sign, sign, sign]))
            np.subtract.at(keys, at, np.concatenate([key, key, key]))
            np.subtract.at(check, at, np.concatenate([hashed, hashed, hashed]))
        if count.any() or keys.any():
            return None
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *mine]), np.concatenate([none, *theirs])


class Version:
    """A text's digests and its sketches by size, the larger ones made when they are asked for."""

    def __init__(self, text: str, salt: int = 0):
        self.text, self.salt = text, salt
        self.keys = digests(text, salt)
        self.check = _check(self.keys)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, size: int = CELLS) -> Sketch:
        if size not in self.sketches:
            self.sketches[size] = Sketch(self.keys, self.check, size)
        return self.sketches[size]


def differing(a: Version, b: Version) -> tuple[np.ndarray, np.ndarray]:
    """Digests that only one version holds.

    A digest of either side adds 1 to the squared counts of three cells of the
    difference, so the smallest sketches tell about how many there are, and the
    first size to peel has room for those.  Where it gets stuck, the next is larger.
    """
    size = CELLS
    about = float(np.square(a.sketch().count - b.sketch().count).sum()) / 3
    while size < 1.4 * about:
        size *= GROWTH
    while (found := a.sketch(size).difference(b.sketch(size))) is None:
        if size > 64 * (len(a.keys) + len(b.keys) + CELLS):
            # Pieces of one digest can't be told apart at any size; other digests tell them apart.
            return differing(Version(a.text, a.salt + SALT), Version(b.text, b.salt + SALT))
        size *= GROWTH
    return found


def likeness(a: Version, b: Version) -> float:
    total = len(a.keys) + len(b.keys)
    if not total:
        return 1.0
    mine, theirs = differing(a, b)
    return max(0.0, min(1.0, (total - len(mine) - len(theirs)) / total))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def describe(doc_id, own: Version, following: Version) -> tuple:
    version = Version(edited(own.text, following.text))
    return (
        doc_id, len(own.text), hashlib.sha256(version.text.encode("utf-8")).hexdigest(), own.sketch().text(), version.sketch().text(), likeness(own, version), likeness(own, following),
    )


_NAMES = [c.split(" ")[0] for c in ROW.split(", ")]


def _frame(rows: list[tuple], extra: dict) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out.assign(**extra)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``ROW`` for each row of ``docs``.

    The next document is the one with the next smaller id (null ids last, rows
    of one id by text), and after the last one the first, which for a single row
    is that row itself.  Null texts count as empty: no pieces, and as like to
    each other as can be.  Other columns are not read.
    """

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            rows, ends = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id, own = None if pd.isna(doc_id) else int(doc_id), Version(text)
                if held is None:
                    ends.append((doc_id, text))
                else:
                    rows.append(describe(*held, own))
                held = (doc_id, own)
            if rows:
                yield _frame(rows, {"part": part, "end": 0, "text": None})
            if ends:
                yield _frame([(ends[0][0], *[None] * 6)], {"part": part, "end": 1, "text": ends[0][1]})
        if held is not None:
            yield _frame([(held[0], *[None] * 6)], {"part": part, "end": 2, "text": held[1].text})

    def pair_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _frame([describe(None if pd.isna(i) else int(i), Version(a), Version(b)) for i, a, b in zip(batch["doc_id"], batch["text"], batch["following"], strict=True)], {})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order, "text")
    done = materialize(dealt.mapInPandas(run_task, f"{ROW}, part int, end int, text string"), "sketches")
    heads = done.where("end = 1").select("part", F.col("text").alias("following"))
    # Which task comes next: one narrow row for each task.
    in_order = Window.orderBy("part")
    after = done.where("end = 1").select("part").withColumn("to", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    last = done.where("end = 2").select("part", "doc_id", "text").join(after, "part").join(heads.withColumnRenamed("part", "to"), "to")
    return done.where("end = 0").select(*_NAMES).unionByName(last.select("doc_id", "text", "following").mapInPandas(pair_ends, ROW))


def op3_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
