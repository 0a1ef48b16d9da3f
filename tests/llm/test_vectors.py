"""Top-k search and vector codes against brute force and SQL."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tideline.llm import topk, vector_codes, vectors

ROWS = "vec_id long, embedding array<float>, label int, row int, ints string, block date, score double, code string, n long"


def vectors_df(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x", None, 0.5, "c", 2) for i, v, l in rows], ROWS).repartition(3)


def odd_vectors(seed=3, n=160, width=20):
    """Vectors with ties and copies beside null, broken, short and empty ones, repeated rows, null ids and null labels."""
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=width).round(1)], int(i % 3) if i % 5 else None) for i in range(n)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)] + [rows[7], rows[0], rows[0], (None, rows[4][1], None), (None, rows[5][1], 2)]
    rows += [(2000, None, 1), (2100, [1.0, None] * 10, 1), (2200, [float("nan")] * width, 1), (2300, [1.0, float("inf")] * 10, None), (2400, [0.5, -0.25, 0.125], 0), (2500, [], 0), (2600, [0.0] * width, 9)]
    return rows


def kept(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_top(rows, k, every):
    whole = kept(rows, 1024)
    out = []
    for a, (i, v, _) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), math.inf if j is None else j) for b, (j, w, _) in enumerate(whole) if b != a)
        out += [(i, rank, None if j == math.inf else j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "candidates", "queries"), [(10, 4096, 8192), (10, 16, 3), (1, 7, 2), (300, 32, 8192)])
def test_top_scores_equal_brute_force(spark, k, candidates, queries):
    rows = odd_vectors()
    got = topk.top_scores(vectors_df(spark, rows), k=k, every=20, candidates=candidates, queries=queries).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=repr) == brute_top(rows, k, 20)


def test_no_vectors(spark):
    df = vectors_df(spark, odd_vectors())
    assert topk.top_scores(df.where("false")).count() == 0 and vector_codes.vector_codes(df.where("false")).count() == 0
    one = vectors_df(spark, [(0, [1.0, 2.0], 1)])
    assert topk.top_scores(one).count() == 0
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.vector_codes(one).collect()] == [(0, "00" * 8, 0, 0)]


def test_lists_stop_early_and_lose_nothing():
    """Where few dimensions matter, a query reads a small part of its lists."""
    r = np.random.default_rng(1)
    v = r.integers(-900, 900, (4000, 6))
    v[:, 2:] //= 300
    block = topk.Block(v, np.arange(4000), np.arange(4000))
    for q in (np.array([9, -4, 0, 0, 1, 0]), np.zeros(6, int), v[5]):
        want = sorted(((int(s), -i) for i, s in enumerate(v @ q) if i != 5), reverse=True)[:10]
        assert [(s, -i) for s, i, _ in block.best(q, 5, 10)] == want
        floor = want[4][0]
        assert [(s, -i) for s, i, _ in block.best(q, 5, 10, floor)] == [w for w in want if w[0] >= floor]
    read = []
    block.lists = type("Counted", (), {"__getitem__": lambda self, at, held=block.lists: read.append(at[1].stop) or held[at]})()
    block.best(np.array([9, -4, 0, 0, 0, 0]), -1, 10)
    assert max(read) < 1000


def test_scores_beyond_double_precision():
    v = np.array([[1 << 61, 1], [1 << 61, 3], [-(1 << 62), 5]], np.int64)
    block = topk.Block(v, np.arange(3), np.arange(3))
    assert [(i, s) for s, i, _ in block.best(np.array([1, 1], np.int64), -1, 3)] == [(1, (1 << 61) + 3), (0, (1 << 61) + 1), (2, 5 - (1 << 62))]
    assert block.best(np.array([8, 0], np.int64), -1, 1)[0][0] == vectors.LONG_MAX


def brute_codes(rows, parts=8, entries=16, rounds=6):
    whole = kept(rows, 4096)
    width = -(-max(len(v) for _, v, _ in whole) // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    padded = [list(v) for _, v, _ in whole]
    order = sorted(range(len(whole)), key=lambda a: (whole[a][0] is None, whole[a][0] or 0, padded[a]))
    books = [[list(cut[a][p]) for a in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, sum(e for e, (_, _, m) in zip(errors, whole, strict=True) if m == l), digest) for (i, _, l), f, err in zip(whole, found, errors, strict=True)), key=repr)


@pytest.mark.parametrize("hot", [1000, 3])
def test_codes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", hot)
    rows = odd_vectors()
    got = vector_codes.vector_codes(vectors_df(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr) == brute_codes(rows)


def test_fewer_vectors_than_entries_and_unused_entries(spark):
    rows = [(i, [float(i // 2)] * 8, None) for i in range(7)]
    got = vector_codes.vector_codes(vectors_df(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr) == brute_codes(rows)


def test_bounds_leave_out_entries_and_keep_the_nearest():
    r = np.random.default_rng(2)
    book = r.integers(-2000, 2000, (16, 8))
    rows = np.concatenate([book[r.integers(0, 16, 500)] + r.integers(-60, 60, (500, 8)), book[:3], book[:3]])
    book[9] = book[4]  # equally near: the first one counts
    entry, distance, exact = vector_codes.nearest(rows, book)
    all_ = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (entry == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert exact < all_.size / 2
    wide = np.array([[1 << 62, 0], [-(1 << 62), 1], [3, 4]], np.int64)
    entry, distance, _ = vector_codes.nearest(wide, wide[::-1].copy())
    assert entry.tolist() == [2, 1, 0] and distance.tolist() == [0, 0, 0]
