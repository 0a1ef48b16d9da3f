"""The pipeline's near-copy stage against brute force on whole shingle sets."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tideline.llm import near


def brute_sets(texts):
    out = {}
    for i, t in texts:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_roots(texts):
    sets = brute_sets(texts)
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b)) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed=11):
    """Originals with copies of one to nine changed words, one group larger than a posting compares in pairs, and short texts."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        texts += [" ".join(words)] + [edited(rng, words, e) for e in rng.sample(range(1, 10), 4)]
    words = [f"v{rng.randrange(3000)}" for _ in range(300)]
    texts += [edited(rng, words, rng.randrange(0, 6)) for _ in range(80)]
    texts += ["", "one", "One  ", "one two", "a b c d e", "A B c d  e", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_drops_what_brute_force_finds(spark):
    texts = corpus()
    root = brute_roots(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    want = {i for i in root if root[i] == i}
    assert 100 < len(want) < 300
    assert kept == want


@pytest.mark.parametrize("few", [2, near.FEW])
def test_large_family_loses_no_link(spark, monkeypatch, few):
    """Copies of one text that are near to it, and not to each other: a few links hold a large posting together."""
    monkeypatch.setattr(near, "FEW", few)
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(260)]
    texts = [(i, edited(rng, words, 5)) for i in range(90)] + [(200, " ".join(words))]
    texts += [(300 + i, edited(rng, words[:130] + [f"x{rng.randrange(5000)}" for _ in range(130)], 2)) for i in range(40)]
    root = brute_roots(texts)
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert got == root and 1 < len(set(root.values())) < 100


def test_families_that_share_their_edits(spark, monkeypatch):
    """Copies whose changes come from few words and places meet outside their reference; some are shorter than it, and some reach the finer levels."""
    monkeypatch.setattr(near, "FEW", 3)
    reached = []
    finer = near.finer_keys
    monkeypatch.setattr(near, "finer_keys", lambda sets, level: reached.append(level) or finer(sets, level))
    rng = random.Random(8)
    texts = []
    for family in range(3):
        words = [f"f{family}w{rng.randrange(4000)}" for _ in range(110)]
        for _ in range(90):
            own = list(words)
            for _ in range(rng.randrange(1, 8)):
                own[rng.randrange(0, 110, 6)] = f"e{rng.randrange(3)}"
            a = rng.choice([0, 0, 0, 4, 9])
            texts.append(" ".join(own[a : 110 - rng.choice([0, 0, 5])]))
    root = brute_roots(list(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == root and 3 < len(set(root.values())) < 240 and reached


def test_pairs_are_tallied_before_they_are_verified(spark, monkeypatch):
    """The count filter keeps every pair of near copies and leaves out pairs of few common positions."""
    rng = random.Random(15)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = list(enumerate([" ".join(words), "a b c d e f g h", "a b c d e f g h i"] + [edited(rng, words, e) for e in range(1, 60)]))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = brute_sets(texts)
    id_of = {r["node"]: r["doc_id"] for r in near.signatures(df).collect()}
    nodes = near.signatures(df).select("node", "bytes")
    pairs = nodes.selectExpr("node as u").crossJoin(nodes.selectExpr("node as v")).where("u > v")
    got = {frozenset((id_of[r["u"]], id_of[r["v"]])) for r in near.tallied(pairs, nodes).collect()}
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    close = {frozenset(p) for p, x in like.items() if x >= 0.8}
    assert len(close) > 5 and close <= got and not any(frozenset(p) in got for p, x in like.items() if x < 0.2)
    asked = []
    kept = near.tallied
    monkeypatch.setattr(near, "tallied", lambda *a: asked.append(1) or kept(*a))
    near.near_copies(df).collect()
    assert len(asked) > 1


def test_rows_without_an_id_stay(spark):
    rows = [(3, "a b c d e f g"), (None, "a b c d e f g"), (None, "p q r s t"), (5, "A b c d e f G")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near.drop_near_copies(df).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 3]
    assert near.drop_near_copies(df.where("false")).count() == 0
