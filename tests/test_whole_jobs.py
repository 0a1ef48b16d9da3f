"""Queries and operators over all of their rows."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import layout, multiplicity
from tideline.plans import estimators, queries
from tideline.sources.bindings import daily


def brute_bh(rows):
    """``id: (q, rank)`` of ``id, p``."""
    known = sorted((p, i) for i, p in rows if p is not None)
    out, low = {i: (None, None) for i, _ in rows}, 1.0
    for j in range(len(known), 0, -1):
        p, i = known[j - 1]
        low = min(low, len(known) / j * p)
        out[i] = (low, j)
    return out


def test_ranged_bh_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, None if i % 17 == 0 else 0.25 if i % 3 == 0 else round(rng.random(), 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "family string, id long, p double").repartition(3)
    for family in ([], ["family"]):
        got = {x["id"]: x for x in multiplicity.benjamini_hochberg_ranged(df, family=family, ranges=7).collect()}
        assert len(got) == len(rows)
        for f in {r[0] for r in rows} if family else {0}:
            for i, (q, rank) in brute_bh([(i, p) for g, i, p in rows if not family or g == f]).items():
                assert got[i]["rank"] == rank and (q is None) == (got[i]["q"] is None)
                assert q is None or got[i]["q"] == pytest.approx(q, abs=1e-12)
    assert multiplicity.benjamini_hochberg_ranged(df.where("false")).count() == 0


def test_bh_of_every_order(spark, sf):
    tests = queries._p_values(spark, sf).collect()
    want = brute_bh([(x["id"], x["p"]) for x in tests])
    got = queries.QUERIES["bh_qvalues_all"](spark, sf).collect()
    assert len(got) == len(tests) == spark.read.parquet(f"{sf}/orders.parquet").count()
    for x in got:
        q, rank = want[x["id"]]
        assert x["rank"] == rank and (q is None or x["q"] == pytest.approx(q, abs=1e-7))


def brute_periodogram(t, v):
    """Scargle's normalised power of ``t, v`` by period."""
    n, span, var = len(t), t.max() - t.min(), v.var(ddof=1)
    first, step = 2 / span, 1 / (5 * span)
    out = []
    for k in range(math.floor((0.5 + 1e-12 - first) / step) + 1):
        w = 2 * math.pi * (first + k * step)
        a = w * t - math.atan2(np.sin(2 * w * t).sum(), np.cos(2 * w * t).sum()) / 2
        c, s, r = np.cos(a), np.sin(a), v - v.mean()
        out.append((2 * math.pi / w, ((r @ c) ** 2 / (c @ c) + ((r @ s) ** 2 / (s @ s) if s @ s > 1e-12 * n else 0.0)) / (2 * var)))
    return sorted(out), n


def test_periodogram_of_every_day(spark, sf):
    rows = [x for x in daily(spark, sf).select("d", "y").orderBy("d").collect()]
    t = np.array([(x["d"] - rows[0]["d"]).days for x in rows if x["y"] is not None], float)
    want, _ = brute_periodogram(t, np.array([x["y"] for x in rows if x["y"] is not None]))
    got = sorted((x["period"], x["power"]) for x in queries.QUERIES["lomb_scargle_all"](spark, sf).collect())
    assert len(got) == len(want) and got[-1][0] > 1000
    assert np.allclose(np.array(got), np.array(want), rtol=1e-6, atol=2e-6)
    best = max(want, key=lambda x: (round(x[1], 9), -x[0]))
    peak = {x["series"]: x for x in queries.QUERIES["rhythms_all"](spark, sf).collect()}
    assert set(peak) == {"y", "x"} and peak["y"]["power"] == pytest.approx(best[1], abs=2e-6)


def test_modality_of_every_day(spark, sf):
    n = daily(spark, sf).where("x is not null").count()
    got = estimators.QUERIES["modality"](spark, sf).first()
    assert got["n"] == n > 2000
    assert got["p"] is None or abs(got["p"] * 201 - round(got["p"] * 201)) < 1e-9
    assert sum(x["cnt"] for x in estimators.QUERIES["strain_distribution"](spark, sf).collect()) == n


def test_pack_rows_packs_every_event(spark, sf):
    pages = defaultdict(list)
    got = estimators.QUERIES["pack_rows"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/events.parquet").count()
    for x in got:
        pages[x["user_id"], x["day"]].append(x)
    for page in pages.values():
        page.sort(key=lambda x: x["ord"])
        assert [(x["row"], x["width"]) for x in page] == layout.pack([x["span"] for x in page], [x["is_on"] for x in page])


def test_slack_goes_one_each_to_the_first():
    assert [w for _, w in layout.pack([3, 3, 4], [True] * 3)] == [4, 4, 4]
    assert [w for _, w in layout.pack([4, 6], [True] * 2)] == [5, 7] and [w for _, w in layout.pack([3, 3, 3, 3, 3], [True] * 5)] == [3, 3, 3, 3, 12]
    assert layout.pack([3, 3, 4, 4, 12], [True, False, True, False, False]) == [(0, 12), (1, 12), (2, 12), (3, 6), (3, 6)]
    assert [w for _, w in layout.pack([3, 3, 3, 2], [True] * 4)] == [4, 3, 3, 2]


def test_whole_texts_are_shortened(spark, sf):
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {x["doc_id"]: x["out"] for x in queries.QUERIES["shorten_text_all"](spark, sf).collect()}
    assert set(got) == set(texts)
    assert all(out is None or len(out) <= 34 for out in got.values())
    assert all(out.endswith("…") for i, out in got.items() if texts[i] and len(texts[i]) > 60)


def test_pages_are_packed_as_they_come(spark):
    """Many pages a task, and pages longer than a batch; a page is no group of its own."""
    rng = random.Random(6)
    rows = []
    for page in range(120):
        on = True
        for k in range(rng.choice([1, 1, 2, 5, 60])):
            on = on if rng.random() < 0.8 else not on
            rows.append((None if page == 7 else page, page % 2, k, rng.choice([0, 1, 2, 3, 4, 6, 9, 12, 14]), on))
    df = spark.createDataFrame(rows, "page long, half int, ord long, span int, is_on boolean").repartition(5)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        packed = layout.pack_rows(df, ["page", "half"])
        assert "FlatMapGroups" not in packed._jdf.queryExecution().toString()
        got = packed.collect()
        whole = layout.pack_rows(df.withColumn("ord", F.xxhash64("page", "ord"))).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sorted((x["page"] or -1, x["ord"]) for x in got) == sorted((r[0] or -1, r[2]) for r in rows)
    pages = defaultdict(list)
    for x in sorted(got, key=lambda x: x["ord"]):
        pages[x["page"]].append(x)
    for page in [*pages.values(), whole]:
        assert [(x["row"], x["width"]) for x in page] == layout.pack([x["span"] for x in page], [x["is_on"] for x in page])
    assert layout.pack_rows(df.where("false"), ["page", "half"]).count() == 0
