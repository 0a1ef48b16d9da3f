"""Operator 8: BPE encoding and decoding with a contiguous rank array.

A word is held as an array of its parts, in which boundaries are places, and an
array of the ranks of the boundaries between adjacent parts.  The smallest rank is looked for again and again, its
boundary is deleted, and the two neighbouring ranks are looked up anew.  Words
beyond ``SHORT`` symbols, where repeated scans would be quadratic, keep the same
arrays as a linked list under a heap.

Text goes through the vocabulary file's own steps first: special tokens cut the
raw text, then NFC, lower case by character, the split into word-like pieces
(white space is dropped) and the byte alphabet with word ends.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import LATIN_LETTERS, BoundedCache, classes_alike, plain_latin, table, whole_text

SHORT = 128
CACHE_WORDS = 120_000
CACHE_WORD_CHARS = 64
#: (rank, id) of a boundary that no merge crosses.
NO_MERGE = (1 << 60, -1)


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where printable in Latin-1, else the next from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merge_word(parts: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The ids of one short word after all merges.

    ``parts`` holds the id between each two neighbouring boundaries and ``ranks``
    the rank of each inner boundary, as contiguous arrays.
    """
    get = merges.get
    ranks = [get(a << 16 | b, NO_MERGE) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks:
        low = min(ranks)
        if low is NO_MERGE:
            break
        i = ranks.index(low)
        # Delete the boundary; its neighbours have new pairs.
        parts[i] = low[1]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << 16 | parts[i], NO_MERGE)
        if i < len(ranks):
            ranks[i] = get(parts[i] << 16 | parts[i + 1], NO_MERGE)
    return parts


def merge_long_word(parts: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The same ids in n log n steps, for words too long to scan again and again."""
    n = len(parts)
    held: list[int | None] = list(parts)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (m := merges.get(a << 16 | b))]
    heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i]
        if held[i] != a or j >= n or held[j] != b:
            continue
        held[i], held[j] = new, None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n and (m := merges.get(held[k] << 16 | held[right[k]])):
                heapq.heappush(heap, (m[0], k, held[k], held[right[k]], m[1]))
    return [p for p in held if p is not None]


class WordBpe:
    """Encoder and decoder for a vocabulary file of the kind of ``word_bpe_49k.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        if len(self.vocab) > 1 << 16:
            raise ValueError("pairs are packed as two 16-bit ids")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {self.vocab[a] << 16 | self.vocab[b]: (i, self.vocab[a + b]) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        # The same split in Python's own classes, for texts whose characters those sort alike.
        self.plain = re.compile(split["pattern"]["Regex"].replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"))
        self.latin = re.compile(rf"[{LATIN_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{LATIN_LETTERS}0-9]+")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in self.alphabet]
        self.last = [self.vocab[c + self.end] for c in self.alphabet]
        self.path = path
        self.library = None
        self.cache = BoundedCache(CACHE_WORDS)

    def normalise(self, text: str) -> str:
        """NFC and lower case; white space, which the split drops, stays as it is."""
        if not text.isascii():
            # Lower case goes by character here, so a final sigma is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word(self, piece: str) -> tuple[bytes, str]:
        """The ids of a piece as little-endian bytes, and its decoded form."""
        raw = piece.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        ids = (merge_word if len(parts) <= SHORT else merge_long_word)(parts, self.merges)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])

    def _split_by_library(self, text: str) -> list[str]:
        """The pieces of a text with code points newer than Python's tables, by the library's tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        code = {c: b for b, c in enumerate(self.alphabet)}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(code[c] for c in p).decode("utf-8") for p, _ in pieces]

    def _words(self, text: str) -> list[tuple[bytes, str]]:
        if plain_latin(text):
            # NFC leaves Latin-1 as it is.
            pieces = self.latin.findall(text.lower())
        elif classes_alike(text):
            pieces = self.plain.findall(self.normalise(text))
        else:
            pieces = self._split_by_library(text)
        found = list(map(self.cache.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                piece = pieces[at]
                held = self.cache.find(piece)
                if held is None:
                    held = self.word(piece)
                    if len(piece) <= CACHE_WORD_CHARS:
                        self.cache.put(piece, held)
                found[at] = held
        except ValueError:
            return found

    def encode_bytes(self, text: str) -> tuple[bytes, list[str]]:
        """All ids of a text as little-endian unsigned 32-bit integers, and the decoded words."""
        ids, words = [], []
        for k, segment in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if k % 2:
                ids.append(self.special[segment].to_bytes(4, "little"))
                words.append(segment)
            elif segment:
                found = self._words(segment)
                ids += [x[0] for x in found]
                words += [x[1] for x in found]
        return b"".join(ids), words

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_bytes(text)[0]).cast("I"))

    def decode(self, ids) -> str:
        """The file names no decoder, so the parts are joined by spaces."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    A null text counts as empty: no tokens and the digests of nothing.  Rows are
    taken as they come, repeated ones each for itself; other columns are not
    read.  Each task loads the vocabulary file at ``path``.
    """
    path = path or default_vocabulary()

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            n, ids_hex, decoded_hex = [], [], []
            for text in batch["text"]:
                ids, words = bpe.encode_bytes(text)
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                decoded_hex.append(hashlib.sha256(" ".join(words).encode("utf-8")).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids_hex, "decoded_sha256": decoded_hex})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(run_task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
