"""Operator 13: token groups that two tokenizers have in common.

A text's bytes get a label each: a token of neither tokenizer ends there, one of
A, one of B, or one of both.  A regular expression cuts the label string after
each both-label; the labels of a span count the tokens of its group.  The tokens
of a group cover the same bytes, and its last tokens, which end together, are a
link.

Texts are cut into stretches where each tokenizer begins anew whatever comes
before or after.  The stretches that a task does not remember are encoded and
labelled together, those of many documents at a time; a document's groups are
those of its stretches in order.

How often a pair of ids is linked is counted over all documents.  The pairs that
make up at least one link in ``HEAVY`` are at most ``HEAVY``, so the tasks
hold them in memory; documents meet the others, none of which is frequent, by a
shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import LATIN_LETTERS, BoundedCache, classes_alike, materialize, plain_latin, table, whole_text
from .token_codes import _PACK, CACHE_CHARS, PieceEncoder

#: Pairs with at least one link in so many are held in memory, at 17 bytes each.
HEAVY = 100_000
CACHE_WORDS = 300_000
CACHE_STRETCHES = 300_000
#: Documents of so many characters are cut before what is new in them is encoded.
CHUNK_CHARS = 1 << 18
CACHE_SPANS = 50_000
CACHE_SPAN_BYTES = 32
A_END, B_END = 1, 2
#: A span goes to the first byte where both end.
SPAN = re.compile(rb"[^\x03]*\x03", re.DOTALL)
BLANK = "▁"

_DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_NAMES = [column.split(" ")[0] for column in _DOCS.split(", ")]


class Inexact(Exception):
    """A tokenizer does not give back what it was given."""


def packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)].pack(*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


class ExactPieces(PieceEncoder):
    """Tokenizer A, to which the strings of special tokens are plain text; what it gives is compared with the text's bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special = []
        self.library.encode_special_tokens = True
        self.bytes = token_bytes_a(self)

    def ids(self, stretch: str) -> list[int]:
        if stretch.isascii() and stretch.isprintable():
            coded = [piece.replace(" ", self.alphabet[32]) for piece in self.split(stretch)]
        else:
            coded = [piece.encode().decode("latin-1").translate(self.alphabet) for piece in self.split(stretch)]
        return [t.id for piece in coded for t in self.model.tokenize(piece)]

    def verified(self, ids: bytes, text: str) -> bytes:
        if b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))) != text.encode():
            raise Inexact
        return ids

    def _piece(self, piece: str) -> bytes:
        held = self.cache.find(piece)
        return self.verified(super()._piece(piece), piece) if held is None else held

    def encode(self, text: str) -> bytes:
        if plain_latin(text) or classes_alike(text):
            return super().encode(text)  # piece by piece
        return self.verified(super().encode(text), text)


class WordPieces:
    """Tokenizer B by runs of letters, single digits and runs of other characters, each with the blanks before it.

    Merges never join two of these runs unless a piece of the vocabulary spans
    them; such pieces are looked up when it is loaded, and a text that holds the
    string of one is encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.library.id_to_piece(i) for i in range(len(self.library))]
        self.runs = re.compile(r" *[^\W\d_]+| *\d| *(?:[^\w ]|_)+| +").findall
        plain = [n.replace(BLANK, " ") for i, n in enumerate(self.names) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.spanning = [n for n in plain if self.runs(n) != [n]]
        # What a line break gives after the blank that the library puts before a text; nothing merges with a byte.
        self.after_break = len(self.library.encode("\n"))
        if any("\n" in n for n in plain) or self.after_break != 2:
            raise ValueError("this vocabulary has pieces across lines")
        self.one_blank = [self.library.piece_to_id(BLANK)]
        self.bytes = token_bytes_b(self)
        self.cache = BoundedCache(CACHE_WORDS)

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of distinct runs, by one call of the library for all that are not remembered."""
        known = {run: self.cache.find(run) for run in runs}
        fresh = [run for run, held in known.items() if held is None]
        for run, ids in zip(fresh, self.ids(fresh), strict=True):
            held = known[run] = self.verified(ids, run)
            if len(run) <= CACHE_CHARS:
                self.cache.put(run, held)
        return known

    def ids(self, parts: list[str]) -> list[list[int]]:
        """The ids of runs, or of several together, each as within a text, by one call of the library."""
        if not parts:
            return []
        # The library puts a blank before what it is given, and gives nothing for nothing.
        given = self.library.encode([x[1:] if x[0] == " " else "\n" + x for x in parts], num_threads=1)
        return [(ids if x != " " else self.one_blank) if x[0] == " " else ids[self.after_break :] for x, ids in zip(parts, given, strict=True)]

    def verified(self, ids: list[int], text: str) -> bytes:
        if b"".join(map(self.bytes.__getitem__, ids)) != text.encode():
            raise Inexact
        return packed(ids)

    def encode(self, spaced: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; ``spaced`` begins with the blank that the library adds."""
        if any(s in spaced for s in self.spanning):
            return self.verified(self.library.encode(spaced[1:]), spaced)
        runs = self.runs(spaced)
        found = list(map(self.cache.get, runs))
        if None in found:
            places = [k for k, held in enumerate(found) if held is None]
            learnt = self._learn([runs[k] for k in places])
            for k in places:
                found[k] = learnt[runs[k]]
        return b"".join(found)


def token_bytes_a(encoder: PieceEncoder) -> list[bytes]:
    back = {ord(c): b for b, c in enumerate(byte_alphabet())}
    names = [encoder.library.id_to_token(i) or "" for i in range(encoder.library.get_vocab_size())]
    # The special token has letters that are no byte's; it never comes up.
    return [bytes(back[ord(c)] for c in n) if all(ord(c) in back for c in n) else n.encode() for n in names]


def token_bytes_b(pieces: WordPieces) -> list[bytes]:
    return [bytes([int(n[3:5], 16)]) if pieces.library.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(pieces.names)]


def labels(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> bytes:
    """The label of each of n bytes."""
    out = np.zeros(n, np.uint8)
    out[ends_a - 1] |= A_END
    out[ends_b - 1] |= B_END
    return out.tobytes()


def span_counts(span: bytes) -> int:
    """How many tokens of A (in the high half of a long) and of B end in a span."""
    both = span.count(A_END | B_END)
    return span.count(A_END) + both << 32 | span.count(B_END) + both


def cutter(letter: str, digit: str, mark: str, other: str):
    """The cut of a text into stretches, from what matches a character of each class.

    Both tokenizers begin anew after a run of letters or digits, and after marks
    (with one line break) before such a run, with or without one blank.  What has
    more white space, or a quote before letters, goes with the run behind it.
    """
    run = f"{letter}+|{digit}+"
    ahead = f"(?= ?(?:{letter}|{digit}))"
    return re.compile(f" ?{letter}+| ?{digit}+|(?!'{letter}) ?{mark}++\n?+{ahead}|\n{ahead}|{other}*(?:{run})|{other}+").findall


#: What is known of a stretch: its part of the listing, its links as 64-bit integers, its tokens of A (in the high half) and of B.
Known = tuple[bytes, bytes, int]
#: Of one whose bytes a tokenizer does not give back; no text has so many tokens.
INEXACT: Known = (b"", b"", 1 << 96)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ExactPieces(path_a), WordPieces(path_b)
        self.size_a = np.array([len(x) for x in self.a.bytes])
        self.size_b = np.array([len(x) for x in self.b.bytes])
        self.many_a, self.many_b = len(self.size_a), len(self.size_b)
        # An id in decimal with what follows it: within A, after A's last, within B, after B's last.
        self.shown = np.array([f"{i}{end}".encode() for ends, many in (((",", "|"), self.many_a), ((",", ";"), self.many_b)) for end in ends for i in range(many)], object)
        self.spans = BoundedCache(CACHE_SPANS)
        self.known = BoundedCache(CACHE_STRETCHES)
        self.cut = cutter(r"[^\W\d_]", r"\d", r"(?:[^\s\w]|_)", r"[\W_]")
        self.cut_latin = cutter(f"[{LATIN_LETTERS}]", "[0-9]", rf"[^\s{LATIN_LETTERS}0-9]", f"[^{LATIN_LETTERS}0-9]")

    def _count(self, span: bytes) -> int:
        held = self.spans.find(span)
        if held is None:
            held = span_counts(span)
            if len(span) <= CACHE_SPAN_BYTES:
                self.spans.put(span, held)
        return held

    def groups(self, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A, and of B, each group has."""
        spans = SPAN.findall(labels(ends_a, ends_b, int(ends_a[-1])))
        found = list(map(self.spans.get, spans))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self._count(spans[at])
        except ValueError:
            counts = np.array(found, np.int64)
            return counts >> 32, counts & 0xFFFFFFFF

    def listing(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> list[bytes]:
        """The tokens of ``a1,a2|b1;a3|b2,b3;``, decimal ids each with the character behind it."""
        upto_a, upto_b = np.cumsum(na), np.cumsum(nb)
        codes = np.empty(len(a) + len(b), np.int64)
        place_a = np.arange(len(a)) + np.repeat(upto_b - nb, na)
        place_b = np.arange(len(b)) + np.repeat(upto_a, nb)
        codes[place_a] = a
        codes[place_b] = b + 2 * self.many_a
        codes[place_a[upto_a - 1]] += self.many_a
        codes[place_b[upto_b - 1]] += self.many_b
        return self.shown[codes].tolist()

    def aligned(self, parts: list[str], ids_a: list, ids_b: list) -> list[Known]:
        """What is to be known of stretches, or of whole texts, of the given ids."""
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        many = [np.fromiter(map(len, ids), np.int64, len(parts)) for ids in (ids_a, ids_b)]
        upto_a, upto_b = map(np.cumsum, many)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        whole = [part.encode() for part in parts]
        ends = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
        exact = all(n.min() > 0 for n in many) and np.array_equal(ends_a[upto_a - 1], ends) and np.array_equal(ends_b[upto_b - 1], ends)
        if not exact or not b"".join(map(self.a.bytes.__getitem__, a.tolist())) == b"".join(whole) == b"".join(map(self.b.bytes.__getitem__, b.tolist())):
            if len(parts) == 1:
                return [INEXACT]
            half = len(parts) // 2
            return [known for cut in (slice(half), slice(half, None)) for known in self.aligned(parts[cut], ids_a[cut], ids_b[cut])]
        na, nb = self.groups(ends_a, ends_b)
        last_a = np.cumsum(na)
        links = (a[last_a - 1] * self.many_b + b[np.cumsum(nb) - 1]).astype("<i8").tobytes()
        shown = self.listing(a, b, na, nb)
        to = zip((upto_a + upto_b).tolist(), (8 * np.searchsorted(last_a, upto_a) + 8).tolist(), (many[0] << 32 | many[1]).tolist(), strict=True)
        out, token, link = [], 0, 0
        for upto, up_link, n in to:
            out.append((b"".join(shown[token:upto]), links[link:up_link], n))
            token, link = upto, up_link
        return out

    def whole(self, spaced: str) -> Known:
        """What is known of a text that can't be cut."""
        try:
            a, b = self.a.encode(spaced), self.b.encode(spaced)
        except Inexact:
            return INEXACT
        return self.aligned([spaced], [memoryview(a).cast("I")], [memoryview(b).cast("I")])[0]

    def stretches(self, spaced: str) -> list[str] | None:
        """The stretches of a text, or None where it can't be cut."""
        if any(s in spaced for s in self.b.spanning):
            return None
        return self.cut_latin(spaced) if plain_latin(spaced) else self.cut(spaced) if classes_alike(spaced) else None

    def learn(self, fresh: list[str]) -> dict[str, Known]:
        if not fresh:
            return {}
        learnt = dict(zip(fresh, self.aligned(fresh, list(map(self.a.ids, fresh)), self.b.ids(fresh)), strict=True))
        for stretch, held in learnt.items():
            if len(stretch) <= CACHE_CHARS:
                self.known.put(stretch, held)
        return learnt

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """``n_a, n_b, n_groups, groups_sha256`` of each text and its distinct links with how often each comes."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                yield from self._chunk(held)
                held, chars = [], 0
        yield from self._chunk(held)

    def _chunk(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        rows, holes, fresh = [], [], {}
        for text in texts:
            if not text or BLANK in text:  # the character comes back as a blank
                rows.append([INEXACT])
                continue
            spaced = " " + text
            parts = self.stretches(spaced)
            if parts is None:
                rows.append([self.whole(spaced)])
                continue
            row = list(map(self.known.get, parts))
            for k in [k for k, known in enumerate(row) if known is None]:
                row[k] = self.known.find(parts[k])
                if row[k] is None:
                    fresh[parts[k]] = None
                    holes.append((row, k, parts[k]))
            rows.append(row)
        learnt = self.learn(list(fresh))
        for row, k, part in holes:
            row[k] = learnt[part]
        for row in rows:
            listing, links, n = zip(*row, strict=True)
            n = sum(n)
            if n >= INEXACT[2]:
                yield 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            each = np.sort(np.frombuffer(b"".join(links), "<i8"))
            first = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
            yield n >> 32, n & 0xFFFFFFFF, len(each), hashlib.sha256(b"".join(listing)[:-1]).hexdigest(), each[first], np.diff(np.r_[first, len(each)])


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``_DOCS`` of ``row, doc_id, text``."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                n_a, n_b, n_groups, digests, pairs, times = zip(*both.documents(part.column("text").to_pylist()), strict=True)
                starts = pa.array(np.r_[0, np.cumsum([len(x) for x in pairs])], pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_groups)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *numbers, pa.array(digests, pa.string()), *lists], _NAMES)

    return docs.mapInArrow(run_task, _DOCS)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a batch, how often each comes, and how many each document has."""
    sizes = np.diff(np.asarray(batch.column("pairs").offsets, np.int64))
    return np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten(), np.int64), sizes


def link_counts(found: DataFrame) -> DataFrame:
    """``pair, n`` over all documents; a row for each pair of a batch is shuffled."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, _ = flat(batch)
            each, back = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(each), np.int64)
            np.add.at(total, back, times)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(total)], ["pair", "n"])

    return found.select("pairs", "times").mapInArrow(run_task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def heavy_sums(found: DataFrame, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """The documents' figures with ``best, total``, the sums over their links among the heavy pairs."""
    pairs_h, counts_h, best_h = heavy
    shown = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, sizes = flat(batch)
            at = np.minimum(np.searchsorted(pairs_h, pairs), max(0, len(pairs_h) - 1))
            hit = pairs_h[at] == pairs if len(pairs_h) else np.zeros(len(pairs), bool)
            ends = np.cumsum(sizes)
            each = lambda v: np.diff(np.r_[0, np.cumsum(np.where(hit, v * times, 0))][np.r_[0, ends]])  # noqa: E731, B023
            best, total = (each(best_h[at]), each(counts_h[at])) if len(pairs_h) else (np.zeros(len(sizes), np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*map(batch.column, shown), pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*shown, "best", "total"])

    return found.mapInArrow(run_task, _DOCS.partition(", pairs")[0] + ", best long, total long")


def light_links(found: DataFrame, pairs_h: np.ndarray) -> DataFrame:
    """``row, pair, times`` of the links that are no heavy pair's."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, sizes = flat(batch)
            at = np.minimum(np.searchsorted(pairs_h, pairs), max(0, len(pairs_h) - 1))
            light = pairs_h[at] != pairs if len(pairs_h) else np.ones(len(pairs), bool)
            rows = np.repeat(np.asarray(batch.column("row")), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rows[light]), pa.array(pairs[light]), pa.array(times[light].astype(np.int32))], ["row", "pair", "times"])

    return found.select("row", "pairs", "times").mapInArrow(run_task, "row long, pair long, times int")


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row for each row of ``docs``.

    Texts that are null or empty, and those that a tokenizer does not give back
    byte for byte, have no tokens: zeros and an empty digest.  The strings of
    special tokens are plain text.  Repeated rows count each for itself; other
    columns are not read; an empty table gives no rows.
    """
    import public_tokenizers

    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    found = materialize(aligned(rows, path_a, path_b), "align-documents")
    many_b = _pieces(path_b)
    counts = materialize(link_counts(found), "align-counts").withColumn("b", F.col("pair") % many_b)
    # At most as many rows a key as A has ids.
    highest = counts.groupBy("b").agg(F.max("n").alias("most")).withColumnRenamed("b", "of")
    rated = materialize(counts.join(highest, F.col("b") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "align-pairs")
    links = found.agg(F.sum("n_links")).first()[0] or 0
    weighty = F.col("n").cast("decimal(38,0)") * heavy >= links
    held = rated.where(weighty).orderBy("pair").toPandas()  # at most ``heavy`` rows
    pairs_h, counts_h, best_h = (held[c].to_numpy(np.int64) for c in ("pair", "n", "best"))
    others = rated.where(~weighty).select(F.col("pair").alias("of"), "n", "best")
    light = light_links(found, pairs_h).join(others, F.col("pair") == F.col("of"))
    rest = light.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("light_best"), F.sum(F.col("times") * F.col("n")).alias("light_total")).withColumnRenamed("row", "at")
    sums = heavy_sums(found, (pairs_h, counts_h, best_h)).join(rest, F.col("row") == F.col("at"), "left")
    both = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", both("best", "light_best").alias("n_best"), both("total", "light_total").alias("count_sum"), "groups_sha256")


@lru_cache(maxsize=4)
def _pieces(path: str) -> int:
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups(table(spark, sf_dir, "documents"))
