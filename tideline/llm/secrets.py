"""Operator 9: secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query on trigrams is derived: what
the parse tree makes mandatory is AND, alternatives are OR, and a part that can
be empty or draws on a wide character class asks for nothing.  Each segment of
documents (a bounded slice of an Arrow batch) gets postings, trigram to
documents, for the trigrams the rules ask for; a rule's query is evaluated by
intersecting and uniting postings; and only the documents left are verified with
the expression itself.  A rule without a mandatory trigram scans its whole
segment.  Trigrams are of bytes with A-Z folded, so the index serves rules of
either case.

The base kinds are ``assign``, ``access`` and ``hex``; the rules after them add
spans of their own kinds and never take a base span away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table, whole_text

SEGMENT_BYTES = 2_000_000
CLASS_LIMIT = 4
EXACT_LIMIT = 64

#: True, or ("and", queries), ("or", queries), or a trigram.
Query = bool | bytes | tuple


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    passes: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The base expressions of the contract, with its least lengths.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", False, lambda m: m.end() - m.start() >= 18),
    # A run of hexadecimal digits is one match however long; runs under 16 are dropped.
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Published formats of further credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("git", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"authorization:\x20*bearer\x20+[A-Za-z0-9._~+/=-]{16,}", True),
    Rule("userinfo", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%+-]{1,64}:[^\s:@/]{6,64}@[A-Za-z0-9.-]+"),
)


def _fold(c: int) -> int:
    return c + 32 if 65 <= c <= 90 else c


def _join(kind: str, queries: list[Query]) -> Query:
    whole = kind == "and"
    rest = {q for q in queries if q is not whole} if whole else set(queries)
    if not whole and True in rest:
        return True
    if not rest:
        return whole
    return next(iter(rest)) if len(rest) == 1 else (kind, tuple(sorted(rest, key=repr)))


def _of_strings(strings: set[bytes]) -> Query:
    """What any text holding one of these strings must hold."""
    if not strings or any(len(s) < 3 for s in strings):
        return True
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _analyse(tree) -> tuple[set[bytes] | None, Query]:
    """The folded strings that a part matches, where they are few (else None), and its trigram query."""
    parts: list[tuple[set[bytes] | None, Query]] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            parts.append(({bytes([_fold(arg)])} if arg < 128 else {chr(arg).encode()}, True))
        elif op is sre.IN:
            chars = {_fold(a) for kind, a in arg if kind is sre.LITERAL and a < 128}
            plain = all(kind is sre.LITERAL and a < 128 for kind, a in arg)
            for kind, a in arg:
                if kind is sre.RANGE and a[1] - a[0] < CLASS_LIMIT and a[1] < 128:
                    chars |= {_fold(c) for c in range(a[0], a[1] + 1)}
                    plain = all(k is sre.LITERAL or k is sre.RANGE and r[1] - r[0] < CLASS_LIMIT for k, r in arg)
            parts.append(({bytes([c]) for c in chars} if plain and len(chars) <= CLASS_LIMIT + 2 else None, True))
        elif op is sre.SUBPATTERN:
            parts.append(_analyse(arg[3]))
        elif op is sre.BRANCH:
            branches = [_analyse(b) for b in arg[1]]
            exact = set().union(*(e for e, _ in branches)) if all(e is not None for e, _ in branches) else None
            parts.append((exact if exact is not None and len(exact) <= EXACT_LIMIT else None, _join("or", [_join("and", [q, _of_strings(e) if e is not None else True]) for e, q in branches])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            exact, query = _analyse(body)
            if exact is not None and (low, high) == (0, 1):
                parts.append((exact | {b""}, True))
            elif exact is not None and low == high and len(exact) == 1:
                parts.append(({next(iter(exact)) * low}, True))
            elif low == 0:
                parts.append((None, True))
            else:
                # At least one occurrence, then anything: the strings end here.
                parts.append((None, _join("and", [query, _of_strings(exact) if exact is not None else True])))
        elif op in (sre.AT, sre.ASSERT_NOT):
            parts.append(({b""}, True))
        else:
            parts.append((None, True))
    queries: list[Query] = []
    run: set[bytes] = {b""}
    broken = False
    for exact, query in parts:
        queries.append(query)
        grown = {a + b for a in run for b in exact} if exact is not None else None
        if grown is None or len(grown) > EXACT_LIMIT:
            queries.append(_of_strings(run))
            run, broken = (exact or {b""}), True
        else:
            run = grown
    if broken:
        queries.append(_of_strings(run))
        return None, _join("and", queries)
    return run, _join("and", queries)


def trigram_query(rule: Rule) -> Query:
    """The Boolean trigram query that every match of the rule satisfies; True asks for a full scan."""
    exact, query = _analyse(sre_parse.parse(rule.pattern, re.ASCII))
    return _join("and", [query, _of_strings(exact)]) if exact is not None else query


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1])) if isinstance(query, tuple) else set()


_FOLD = np.array([_fold(i) for i in range(256)], np.uint8)


class TrigramIndex:
    """Postings of the asked-for trigrams over one segment of documents."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.n = len(texts)
        self.postings: dict[int, np.ndarray] = {}
        if not wanted or not texts:
            return
        # A zero byte pair between documents keeps trigrams from spanning them.
        joined = _FOLD[np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)]
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        codes = {int.from_bytes(t, "big") for t in wanted}
        ask = np.zeros((3, 256), bool)
        for t in wanted:
            for i in range(3):
                ask[i, t[i]] = True
        at = np.flatnonzero(ask[0][joined[:-2]] & ask[1][joined[1:-1]] & ask[2][joined[2:]])
        code = joined[at].astype(np.int32) << 16 | joined[at + 1].astype(np.int32) << 8 | joined[at + 2]
        keep = np.isin(code, np.fromiter(codes, np.int32))
        code, doc = code[keep], np.searchsorted(starts, at[keep], "right") - 1
        pairs = np.unique(code.astype(np.int64) << 32 | doc)
        of, docs = pairs >> 32, pairs & 0xFFFFFFFF
        for c in np.unique(of):
            self.postings[int(c)] = docs[np.searchsorted(of, c) : np.searchsorted(of, c, "right")]

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.zeros(0, np.int64))
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            if query[0] == "and" and not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _segments(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > SEGMENT_BYTES:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def find_secrets(texts: list[str], rules: tuple[Rule, ...], queries: list[Query], patterns: list[re.Pattern]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans ``(start, rule, end)`` in code points, sorted."""
    wanted = set().union(*(trigrams_of(q) for q in queries))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in _segments(texts):
        index = TrigramIndex([t.encode("utf-8") for t in texts[a:b]], wanted)
        for r, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
            for d in index.candidates(query):
                for m in pattern.finditer(texts[a + d]):
                    if rule.passes is None or rule.passes(m):
                        spans[a + d].append((m.start(), r, m.end()))
    for s in spans:
        s.sort()
    return spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, a row for each row of ``docs``.

    Spans are ``kind:start:end`` of whole matches in code points, end exclusive,
    by start and then kind as listed.  A null text counts as empty: no spans and
    the digest of nothing.  Other columns are not read.
    """
    rules = (*BASE_RULES, *more)

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, patterns = [trigram_query(r) for r in rules], [r.compiled() for r in rules]
        for batch in batches:
            out = []
            for spans in find_secrets(list(batch["text"]), rules, queries, patterns):
                named = [(r, f"{rules[r].kind}:{s}:{e}") for s, r, e in spans]
                base = [r for r, _ in named if r < len(BASE_RULES)]
                digest = hashlib.sha256(",".join(x for r, x in named if r < len(BASE_RULES)).encode()).hexdigest()
                out.append((base.count(0), base.count(1), base.count(2), digest, ",".join(x for _, x in named)))
            columns = dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), zip(*out, strict=True), strict=True)) if out else {}
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **columns}) if out else pd.DataFrame(columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(run_task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
