"""Fast trigonometric sums and periodograms against direct sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tideline.operators import spectral
from tideline.plans import metrics


def direct(place, weight, first, step, many):
    f = first + step * np.arange(many)
    return (weight[None] * np.exp(-2j * math.pi * f[:, None] * place[None])).sum(1)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("first", [2, 2.37])
def test_sums_equal_direct_ones(whole, first):
    r = np.random.default_rng(1)
    place = np.sort(r.choice(900, 400, replace=False)).astype(float) if whole else np.sort(r.random(400) * 900)
    place -= place[0]
    weight, span = r.normal(size=400), place[-1]
    step, start = 1 / (5 * span), first / span
    many = int((0.5 - start) / step) + 1
    for at in (place, 2 * place):
        want = direct(at, weight, start, step, many)
        assert np.abs(spectral.sums_at(at, weight, start, step, many) - want).max() < 1e-11 * np.abs(want).max()
    for few in (1, 2, 5):
        assert np.allclose(spectral.sums_at(place, weight, start, step, few), direct(place, weight, start, step, few), atol=1e-9)


@pytest.mark.parametrize("whole", [True, False])
def test_power_equals_the_formula(spark, whole):
    r = np.random.default_rng(2)
    t = np.sort(r.choice(300, 180, replace=False)).astype(float) if whole else np.sort(r.random(180) * 300)
    v = np.sin(2 * math.pi * t / 7) + 0.5 * r.normal(size=180)
    rows = [("a", float(x), float(y)) for x, y in zip(t, v, strict=True)] + [(None, float(x), float(y)) for x, y in zip(t[:60], v[:60], strict=True)] + [("few", 1.0, 2.0)]
    got = spectral.lomb_scargle(spark.createDataFrame(rows, "g string, t double, y double").repartition(4), "t", "y", keys=["g"]).collect()
    assert {x["g"] for x in got} == {"a", None}
    for g, n in (("a", 180), (None, 60)):
        x, y = t[:n], v[:n] - v[:n].mean()
        own = sorted((p for p in got if p["g"] == g), key=lambda p: p["k"])
        assert [p["k"] for p in own] == list(range(len(own))) and all(p["n"] == n for p in own)
        for p in own[:: max(1, len(own) // 60)]:
            w = 2 * math.pi / p["period"]
            tau = math.atan2(np.sin(2 * w * x).sum(), np.cos(2 * w * x).sum()) / 2
            c, s = np.cos(w * x - tau), np.sin(w * x - tau)
            sine = (y @ s) ** 2 / (s @ s) if s @ s > 1e-12 * n else 0.0
            assert abs(p["power"] - ((y @ c) ** 2 / (c @ c) + sine) / (2 * y.var(ddof=1))) < 1e-9
    best = max((p for p in got if p["g"] == "a"), key=lambda p: p["power"])
    assert abs(best["period"] - 7) < 0.1 and best["fap"] < 1e-6


def test_rhythms_of_each_entity(spark, sf):
    from pyspark.sql import functions as F

    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    together = metrics.rhythms(o, ["y", "n"], day="d", keys=["o_orderpriority"]).collect()
    name = together[0]["o_orderpriority"]
    alone = {r["series"]: r for r in metrics.rhythms(o.where(F.col("o_orderpriority") == name), ["y", "n"], day="d").collect()}
    own = [r for r in together if r["o_orderpriority"] == name]
    assert len(own) == 2 and all(abs(r[c] - alone[r["series"]][c]) < 1e-9 for r in own for c in ("period", "power", "fap", "q"))
