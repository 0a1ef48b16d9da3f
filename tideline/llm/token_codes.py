"""Operator 4: token ids in a file of directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, least significant first.  Level
0 holds the first chunk of every id; a bitmap beside it says whether the id goes
on, and the ids that do are the entries of level 1, in order, and so forth.  A
rank directory keeps the count of continuing entries before every
``RANK_EVERY``-th, so the place of an id on the next level is one directory
entry plus a popcount of at most ``RANK_EVERY`` bits: any token is read without
decoding others.

A file is a table of shards, a row for each run of documents in id order: the
ids and lengths of its documents and its levels.  Spark writes it, so a lost
task leaves no half file and any store will do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import LATIN_LETTERS, BoundedCache, classes_alike, materialize, plain_latin, table, whole_text

CHUNK_BITS = 8
RANK_EVERY = 512
SHARD_TOKENS = 1 << 20
SHARD_DOCS = 1 << 13
#: Up to so many writing tasks their starts (16 bytes each) are broadcast.
BROADCAST_PARTS = 1 << 18
READ_TOKENS = 1 << 18
CACHE_PIECES = 400_000
#: Longer pieces rarely come again.
CACHE_CHARS = 24
END_ID = 0

_PACK = [struct.Struct(f"<{n}I") for n in range(64)]

LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"
SHARD = f"part int, shard int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, levels array<{LEVEL}>"
_POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of a sequence of unsigned ids."""
    levels, rest = [], np.asarray(ids)
    rest = rest.astype(np.uint32 if not len(rest) or rest.max() < 1 << 32 else np.uint64, copy=False)
    while len(rest) or not levels:
        more = rest >> CHUNK_BITS > 0
        bitmap = np.packbits(more)
        ones = np.zeros(-(-len(bitmap) // (RANK_EVERY // 8)) * (RANK_EVERY // 8), np.uint8)
        ones[: len(bitmap)] = _POPCOUNT[bitmap]
        each = ones.reshape(-1, RANK_EVERY // 8).sum(axis=1, dtype=np.uint32)
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "more": bitmap.tobytes(), "ranks": (np.cumsum(each, dtype=np.uint32) - each).astype("<u4").tobytes()})
        rest = rest[more] >> CHUNK_BITS
        if not len(rest):
            break
    return levels


class Codes:
    """Random access to the ids of one shard."""

    def __init__(self, levels):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4").astype(np.int64)) for x in levels]
        # Popcounts of the bitmap's bytes, summed within each stretch of the directory.
        self.sums = []
        for _, more, _ in self.levels:
            ones = _POPCOUNT[more].astype(np.int64)
            pad = -len(ones) % (RANK_EVERY // 8)
            table_ = np.concatenate([ones, np.zeros(pad, np.int64)]).reshape(-1, RANK_EVERY // 8)
            self.sums.append((np.cumsum(table_, axis=1) - table_).ravel())

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many entries before ``at`` go on: directory, whole bytes, then the bits of one byte."""
        _, more, ranks = self.levels[level]
        byte = at >> 3
        return ranks[at // RANK_EVERY] + self.sums[level][byte] + _POPCOUNT[more[byte] >> (8 - (at & 7)).astype(np.uint8)]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order and number."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint64)
        live = np.arange(len(at))
        for level, (chunks, more, _) in enumerate(self.levels):
            if not len(live):
                break
            out[live] |= chunks[at].astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            goes = (more[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            at = self._rank(level, at[goes]) if goes.any() else at[:0]
            live = live[goes]
        return out.astype(np.uint32)

    def stretch(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``: their entries lie side by side on every level."""
        out = np.zeros(end - start, np.uint32)
        live: np.ndarray | None = None
        for level, (chunks, more, _) in enumerate(self.levels):
            if start >= end:
                break
            part = chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if live is None:
                out = part
            else:
                out[live] |= part
            goes = np.flatnonzero(np.unpackbits(more[start >> 3 : (end + 7) >> 3])[start & 7 : (start & 7) + end - start])
            live = goes if live is None else live[goes]
            if len(goes):
                start = int(self._rank(level, np.array([start]))[0])
            else:
                break
            end = start + len(goes)
        return out


class PieceEncoder:
    """Whole texts to ids with the library's own model, each distinct piece of its split encoded once while it is remembered.

    The model never merges across pieces, so their ids are joined.  Texts that
    hold a special token's string, or characters that Python's classes sort
    otherwise than the library's, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Fixed value: the split of byte-level BPE, with letters, digits and the rest in Python's classes.
        self.split = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.split_latin = re.compile(rf" ?[{LATIN_LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LATIN_LETTERS}0-9]+|\s+(?!\S)|\s+").findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.cache = BoundedCache(CACHE_PIECES)

    def _piece(self, piece: str) -> bytes:
        held = self.cache.find(piece)
        if held is None:
            if piece.isascii() and piece.isprintable():
                coded = piece.replace(" ", self.alphabet[32])
            else:
                coded = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(coded)]
            held = _PACK[len(ids)].pack(*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
            if len(piece) <= CACHE_CHARS:
                self.cache.put(piece, held)
        return held

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        latin = plain_latin(text)
        if any(s in text for s in self.special) or not (latin or classes_alike(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = self.split_latin(text) if latin else self.split(text)
        found = list(map(self.cache.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self._piece(pieces[at])
        except ValueError:
            return b"".join(found)


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, to: str | None = None) -> DataFrame:
    """Encode ``docs`` in ascending id order into a shard table and return that table, read back.

    The table is kept in the folder ``to``, which must be new; without one it is
    a scratch table that goes when the application ends.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        doc_ids: list = []
        held = 0
        encode = encoder(path).encode

        def flush():
            lengths = [len(x) // 4 for x in ids]
            levels = pack(np.frombuffer(b"".join(ids), "<u4"))
            return pd.DataFrame({"part": [part], "shard": [shard], "before": [before], "n_tokens": [sum(lengths)], "doc_ids": [doc_ids], "lengths": [lengths], "levels": [levels]})

        for batch in batches:
            batch_ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for doc_id, text in zip(batch_ids, batch["text"], strict=True):
                own = encode(text)
                ids.append(own + END_ID.to_bytes(4, "little"))
                doc_ids.append(doc_id)
                held += len(own) // 4 + 1
                if held >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                    yield flush()
                    before += held
                    ids, doc_ids, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    coded = ordered.mapInPandas(run_task, SHARD)
    if to is None:
        return materialize(coded, "token-codes")
    coded.write.parquet(to)
    return docs.sparkSession.read.schema(SHARD).parquet(to)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, shard, start``: the tokens before each shard.  The window sees one row for each writing task."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    upto = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("part", upto.alias("part_start"))


def read_codes(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a shard table, read by random access."""

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                codes, lengths = Codes(row.levels), np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                crcs = np.zeros(len(lengths), np.int64)
                k = 0
                while k < len(lengths):
                    a = ends[k] - lengths[k]
                    last = max(k + 1, int(np.searchsorted(ends, a + READ_TOKENS, "right")))
                    ids = codes.stretch(int(a), int(ends[last - 1])).astype("<u4", copy=False)
                    for d in range(k, last):
                        crcs[d] = zlib.crc32(ids[ends[d] - lengths[d] - a : ends[d] - a].tobytes())
                    k = last
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], "Int64"), "start": row.part_start + row.before + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs,
                })

    starts = materialize(shard_starts(shards), "token-starts")
    # One short row a writing task: they go to the shards, which stay where they are.
    beside = F.broadcast(starts) if starts.count() <= BROADCAST_PARTS else starts
    return shards.join(beside, "part").select("part_start", "before", "doc_ids", "lengths", "levels").mapInPandas(run_task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write ``docs`` as directly addressable codes and describe every document from the file.

    Null texts count as empty and hold the end id alone.  Null ids come first;
    rows of one id are ordered by text.  Other columns are not read; an empty
    table gives an empty file and no rows.
    """
    return read_codes(write_codes(docs, id_col, text_col, path))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(table(spark, sf_dir, "documents"))
