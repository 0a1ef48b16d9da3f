"""The fit over any rows against the fit of one group."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import linalg as L
from tideline.operators import regression, treefit

DAY0 = dt.date(2024, 1, 1)


def rows_of(seed, n, days):
    r = np.random.default_rng(seed)
    t = r.integers(0, days, n)
    x = r.normal(size=(n, 2))
    x[:, 1] += 0.6 * x[:, 0]
    y = 1 + x @ [2.0, -1.0] + 0.3 * np.sin(t / 3) + r.normal(size=n) * (1 + np.abs(x[:, 0]))
    y[:: max(2, n // 7)] = np.nan
    return t, x, y


def frame(spark, groups):
    out = []
    for g, (t, x, y) in groups.items():
        out += [(g, DAY0 + dt.timedelta(days=int(a)), float(b[0]), float(b[1]), float(c), float(2 * b[0])) for a, b, c in zip(t, x, y, strict=True)]
    return spark.createDataFrame(out, "g string, d date, a double, b double, y double, twice double").repartition(7)


@pytest.mark.parametrize("kind", [L.HC1, L.HAC])
def test_every_entity_equals_one_fit(spark, kind):
    groups = {"x": rows_of(1, 700, 400), "y": rows_of(2, 60, 2500), None: rows_of(3, 90, 30), "few": rows_of(4, 9, 9)}
    got = regression.ols(frame(spark, groups), "y", ["a", "b", "twice"], kind, keys=["g"]).collect()
    for g, (t, x, y) in groups.items():
        want = L.ols(y, np.column_stack([x, 2 * x[:, 0]]), ["a", "b", "twice"], kind, times=t.astype(float))
        own = [r for r in got if r["g"] == g]
        assert own and all(r["ok"] == want.ok and r["n"] == want.n and r["min_n"] == want.min_n for r in own)
        assert [r["term"] for r in own if r["ok"]] == want.names()
        for r, w in zip((r for r in own if r["ok"]), want.terms, strict=True):
            assert all(abs(r[c] - w[c]) <= 1e-8 * max(1, abs(w[c])) for c in ("coef", "se", "t", "p", "ci_low", "ci_high"))
            assert r["dropped"] == want.dropped and abs(r["r2"] - want.r2) < 1e-9 and abs(r["sigma"] - want.sigma) < 1e-9 and r["bandwidth"] == want.bandwidth


def test_blocks_of_days_lose_no_pair(spark, monkeypatch):
    """Blocks shorter than the bandwidth, and days on both sides of every cut."""
    monkeypatch.setattr(treefit, "BLOCK", 3)
    t, x, y = rows_of(5, 300, 120)
    for width in (0, 1, 3, 10):
        got = regression.ols(frame(spark, {"x": (t, x, y)}), "y", ["a", "b"], L.HAC, width).collect()
        want = L.ols(y, x, ["a", "b"], L.HAC, width, t.astype(float))
        assert np.allclose([r["se"] for r in got], [w["se"] for w in want.terms], rtol=1e-9)


def test_effects_lose_absent_and_first_categories(spark):
    t, x, y = rows_of(6, 400, 300)
    df = frame(spark, {"x": (t, x, y)}).where(F.dayofweek("d") != 4)
    df, dow = regression.weekday_dummies(df)
    got = regression.ols(df, "y", ["a", *dow], effects=[dow]).collect()
    assert [r["term"] for r in got] == ["const", "a", "dow_2", "dow_4", "dow_5", "dow_6", "dow_0"] and got[0]["dropped"] == []
    whole = regression.ols(df, "y", ["a", *dow]).collect()
    assert len(whole[0]["dropped"]) == 2 and whole[0]["k"] == 7


def test_no_rows_and_no_complete_rows(spark):
    df = frame(spark, {"x": rows_of(7, 30, 30)})
    assert regression.ols(df.where("false"), "y", ["a"]).count() == 0
    none = regression.ols(df.withColumn("y", F.lit(None).cast("double")), "y", ["a"]).collect()
    assert len(none) == 1 and not none[0]["ok"] and none[0]["n"] == 0 and none[0]["missing"] == 20


def test_line_items_equal_one_fit(spark, sf):
    from tideline.plans.estimators import _items

    d = _items(spark, sf)
    p = d.toPandas()
    t = (np.array(p["d"], "datetime64[D]").astype(int)).astype(float)
    for kind in (L.HC1, L.HAC):
        want = L.ols(p["y"].to_numpy(), p[["a", "b"]].to_numpy(), ["a", "b"], kind, times=t)
        got = regression.ols(d, "y", ["a", "b"], kind).collect()
        assert all(abs(g[c] - w[c]) < 1e-8 for g, w in zip(got, want.terms, strict=True) for c in ("coef", "se"))
