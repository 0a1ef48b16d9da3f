"""Token groups against a plain loop over both libraries' tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tideline.llm import alignment
from tideline.llm.bpe import byte_alphabet

MORE = [
    "²", "x². y²", "² .", "<s> </s><unk> <0x41> 12 345", "a▁b", "naïve café—“q”… №5", "\n", "   ", "_a_b __ c", " \n \n", "1", "a1b2", "tab\t\tx  \r\n y", "ﬁ ſ ²³¹ ½ x²", "﻿a", "漢字かな交じり文" * 40,
    "a" * 5000 + " b", "end.\nNext line's  end", "<|endoftext|>", "é", "é",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(libraries, docs):
    a_lib, b_lib = libraries
    back = {c: i for i, c in enumerate(byte_alphabet())}
    rows, links = [], []
    for doc_id, text in docs:
        a, b = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, b_lib.encode(text or "")
        bytes_a = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((doc_id, 0, 0, [], ""))
            links.append([])
            continue
        ends = lambda parts: list(np.cumsum([len(p) for p in parts]))
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            ni, nj = at_a[end] + 1, at_b[end] + 1
            groups.append((a[i:ni], b[j:nj]))
            i, j = ni, nj
        links.append([(x, b[at_b[e]]) for x, e in zip(a, ends_a, strict=True) if e in at_b])
        text_form = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((doc_id, len(a), len(b), groups, hashlib.sha256(text_form.encode()).hexdigest()))
    counts = Counter(x for own in links for x in own)
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((d, na, nb, len(g), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), sha) for (d, na, nb, g, sha), own in zip(rows, links, strict=True)), key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 20, 1])
def test_equals_a_plain_loop(spark, libraries, odd_docs, plain_docs, heavy):
    more = [(500 + i, t) for i, t in enumerate(MORE)]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = odd_docs.withColumns({"row": F.lit("x"), "pairs": F.lit(1), "times": F.lit(None).cast("string")}).unionByName(extra, allowMissingColumns=True)
    assert result(alignment.token_groups(docs, heavy=heavy)) == brute(libraries, plain_docs + more)


def test_no_documents(spark, no_docs):
    assert alignment.token_groups(no_docs).count() == 0


def test_query_equals_a_plain_loop(spark, sf, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(alignment.op13_alignment(spark, sf)) == brute(libraries, docs)


def test_spans_and_counts():
    marks = alignment.labels(np.array([1, 3, 6]), np.array([2, 3, 5, 6]), 6)
    assert marks == bytes([1, 2, 3, 0, 2, 3])
    spans = alignment.SPAN.findall(marks)
    assert [divmod(alignment.span_counts(s), 1 << 32) for s in spans] == [(2, 2), (1, 2)]


def test_unknown_runs_of_a_text_are_one_call():
    pieces = alignment.WordPieces(public_tokenizers.path("piece_bpe_32k.model"))
    calls, kept = [], pieces.library

    class Counting:
        def encode(self, given, **more):
            calls.append(given)
            return kept.encode(given, **more)

    pieces.library = Counting()
    text = " zyxqa qwvut  zyxqa\n\t lkjhg7 42 \u00e9t\u00e9 \u65e5\u672c!? "
    want = kept.encode(text[1:])
    for _ in range(2):
        assert list(memoryview(pieces.encode(text)).cast("I")) == want
    assert len(calls) == 1


def aligner():
    return alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("letters", ["abstredlvm", "asteé", "sté日ß\u0301\u0660"])
def test_stretches_are_encoded_as_within_a_text(libraries, monkeypatch, letters):
    monkeypatch.setattr(alignment, "CACHE_STRETCHES", 200)
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 500)
    draw = random.Random(7)
    characters = letters + "A12   \n\n\t''.,!_-\r\xa0\x85\x00"
    texts = ["".join(draw.choices(characters, k=draw.randint(1, 40))) for _ in range(3000)]
    got = [(k, *x[:4]) for k, x in enumerate(aligner().documents(texts))]
    assert got == sorted((d, na, nb, groups, sha) for d, na, nb, groups, _, _, _, sha in brute(libraries, list(enumerate(texts))))


def test_known_stretches_are_not_labelled_again(monkeypatch):
    lengths, label = [], alignment.labels
    monkeypatch.setattr(alignment, "labels", lambda a, b, n: lengths.append(n) or label(a, b, n))
    both = aligner()
    text = "Some words, and some more words; it's 12 words.\nIn all " * 20
    first = list(both.documents([text, text + text]))
    assert sum(lengths) <= len(text) / 10
    again = list(both.documents([text]))
    assert sum(lengths) <= len(text) / 10
    assert again[0][:4] == first[0][:4]


def test_only_texts_with_an_inexact_stretch_have_no_tokens(libraries):
    both = aligner()
    texts = [f"plain {k} words, {'never' if k % 3 else 'always'} more" for k in range(20)]
    want = [x[:4] for x in both.documents(texts)]
    both = aligner()
    both.b.bytes[libraries[1].encode("never")[-1]] = b"?"
    assert [x[:4] for x in both.documents(texts)] == [(0, 0, 0, "") if "never" in t else w for t, w in zip(texts, want, strict=True)]
    assert want[0][0] > 0
