"""Planted answers, hand formulas and invariants of the estimators."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import linalg as L
from tideline.functions import student
from tideline.operators import breaks, days, density, layout, multiplicity, regression, smooth, spectral, stats
from tideline.plans import explorer, metrics

DAY0 = dt.date(2024, 1, 1)


def series(spark, *columns, names="v"):
    names = names.split()
    rows = [(DAY0 + dt.timedelta(days=i), *(None if x is None else float(x) for x in v)) for i, v in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, "d date, " + ", ".join(f"{n} double" for n in names))


def test_student():
    assert math.isclose(student.two_sided_p(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(student.student_quantile(0.975, 10), 2.228138852, rel_tol=1e-6)
    assert student.student_cdf(1.0, 0) == 0.5
    assert math.isclose(student.student_cdf(1.0, 1), 0.75, rel_tol=1e-9)


def test_ols_recovers_exact_coefficients():
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 2))
    x[:, 1] += 0.6 * x[:, 0]
    fit = L.ols(2 + x @ [3, -1.5], x, ["a", "b"])
    assert [t["term"] for t in fit.terms] == ["const", "a", "b"]
    assert np.allclose([t["coef"] for t in fit.terms], [2, 3, -1.5], atol=1e-8)
    assert math.isclose(fit.r2, 1.0)


def test_ols_names_aliased_columns_and_tells_too_few_rows():
    r = np.random.default_rng(2)
    days_ = np.eye(7)[r.integers(0, 7, 140)]
    fit = L.ols(r.normal(size=140), days_, [f"d{i}" for i in range(7)])
    assert fit.ok and len(fit.dropped) == 1 and fit.k == 7
    few = L.ols(r.normal(size=12), r.normal(size=(12, 1)), ["a"])
    assert not few.ok and few.min_n == 20 and few.missing == 8
    gaps = r.normal(size=40)
    gaps[5] = np.nan
    assert L.ols(gaps, r.normal(size=(40, 1)), ["a"]).n == 39


def test_hc1_against_dense_formula_and_hac_at_zero():
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 2))
    y = 1 + x @ [1, 2] + r.normal(size=80) * (1 + np.abs(x[:, 0]))
    fit = L.ols(y, x, ["a", "b"])
    d = np.column_stack([np.ones(80), x])
    a = np.linalg.inv(d.T @ d)
    u = y - d @ (a @ d.T @ y)
    v = a @ (d.T @ (d * (u**2)[:, None])) @ a * 80 / 77
    assert np.allclose(fit.vcov, v, atol=1e-10)
    assert np.allclose(L.ols(y, x, ["a", "b"], L.HAC, 0).vcov, v, atol=1e-10)


def test_hac_against_double_loop():
    r = np.random.default_rng(4)
    n, width = 50, 4
    x, t = r.normal(size=(n, 1)), np.sort(r.choice(90, n, replace=False)).astype(float)
    y = 0.5 * x[:, 0] + r.normal(size=n)
    fit = L.ols(y, x, ["a"], L.HAC, width, t)
    d = np.column_stack([np.ones(n), x])
    s = d * (y - d @ np.linalg.lstsq(d, y, rcond=None)[0])[:, None]
    m = sum(max(0.0, 1 - abs(t[i] - t[j]) / (width + 1)) * np.outer(s[i], s[j]) for i in range(n) for j in range(n) if abs(t[i] - t[j]) <= width)
    a = np.linalg.inv(d.T @ d)
    assert np.allclose(fit.vcov, a @ m @ a * n / (n - 2), atol=1e-10)


def test_hac_covers_better_than_hc1_under_autocorrelation():
    r = np.random.default_rng(5)
    hits = {L.HC1: 0, L.HAC: 0}
    for _ in range(150):
        x, u = np.zeros(300), np.zeros(300)
        e = r.normal(size=(2, 300))
        for i in range(1, 300):
            x[i], u[i] = 0.8 * x[i - 1] + e[0, i], 0.7 * u[i - 1] + e[1, i]
        for kind in hits:
            t = L.ols(2 + 0.5 * x + u, x, ["x"], kind).terms[1]
            hits[kind] += t["ci_low"] <= 0.5 <= t["ci_high"]
    assert hits[L.HC1] / 150 < 0.8 < hits[L.HAC] / 150


def test_ratio_is_refused_where_the_denominator_may_be_zero():
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 2))
    fit = L.ols(x @ [4, 2] + 0.1 * r.normal(size=200), x, ["a", "b"])
    out = L.ratio(fit, "a", "b", negate=True)
    assert out["ok"] and abs(out["coef"] + 2) < 0.05
    assert L.ratio(fit, "a", "zz")["reason"] == "missing-term"
    flat = L.ols(x @ [4, 0] + r.normal(size=200), x, ["a", "b"])
    assert L.ratio(flat, "a", "b")["reason"] == "denominator-covers-zero"


def test_distributed_lag_recovers_weights(spark):
    r = np.random.default_rng(7)
    n = 500
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.6 * x[i - 1] + r.normal()
    y = r.normal(size=n) * 0.3
    for k, w in ((1, -1.2), (2, -0.6), (3, -0.2)):
        y[k:] += w * x[:-k]
    out = regression.distributed_lag(series(spark, y, x, names="y x"), "y", "x", 5).orderBy("lag").collect()
    assert [round(o["coef"], 1) for o in out] == [-1.2, -0.6, -0.2, 0.0, 0.0] or all(abs(o["coef"] - w) < 3 * o["se"] + 0.05 for o, w in zip(out, (-1.2, -0.6, -0.2, 0, 0), strict=True))
    assert math.isclose(out[-1]["cumulative"], sum(o["coef"] for o in out), rel_tol=1e-9)
    none = regression.distributed_lag(series(spark, y, x, names="y x"), "y", "x", 0, 1).collect()
    assert len(none) == 1 and not none[0]["ok"]


def test_simple_ols_agrees_with_general(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=120)
    y = 2 * x + r.normal(size=120)
    df = series(spark, y, x, names="y x")
    for kind in (L.HC1, L.HAC):
        a, b = regression.simple_ols(df, "x", "y", kind).first(), L.ols(y, x, ["x"], kind).terms[1]
        assert math.isclose(a["coef"], b["coef"], rel_tol=1e-9) and math.isclose(a["se"], b["se"], rel_tol=1e-9)


def test_tsqr_matches_one_factorisation(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(500, 3))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double").repartition(5)
    got = regression.qr_of_partitions(df, ["a", "b", "c"])
    assert np.allclose(got.T @ got, x.T @ x)


# The fifteen p-values of the original paper, of which four are rejected at 0.05.
PAPER = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]


def test_benjamini_hochberg_paper(spark):
    tests = spark.createDataFrame([(i, p) for i, p in enumerate(PAPER)] + [(99, None)], "id long, p double")
    out = {x["id"]: x for x in multiplicity.benjamini_hochberg(tests).collect()}
    assert sum(x["sig"] for x in out.values()) == 4
    assert math.isclose(out[3]["q"], 0.035625) and out[99]["q"] is None
    assert np.allclose(multiplicity.bh_values(PAPER), [out[i]["q"] for i in range(15)])


def test_rolling_rules(spark):
    got = series(spark, [1, 2, 3, 4]).select("d", days.rolling_mean(F.col("v"), 7).alias("m")).orderBy("d").collect()
    assert [x["m"] for x in got] == [None, 1.5, 2.0, 2.5]
    nan = series(spark, [1, float("nan"), 3]).select("d", days.rolling_mean(F.col("v"), 7).alias("m")).orderBy("d").collect()
    assert [x["m"] for x in nan] == [None, None, 2.0]


def test_spine_is_contiguous_by_entity(spark):
    df = spark.createDataFrame([("a", DAY0, 1.0), ("a", DAY0 + dt.timedelta(days=3), 2.0), ("b", DAY0, 5.0)], "k string, d date, v double")
    got = days.calendar_spine(df, "d", ["k"]).orderBy("k", "d").collect()
    assert [(x["k"], x["v"]) for x in got] == [("a", 1.0), ("a", None), ("a", None), ("a", 2.0), ("b", 5.0)]
    assert days.calendar_spine(df.where("false"), "d").count() == 0


def test_descriptives(spark):
    d = stats.describe(series(spark, [2, 4, 4, 4, 5, 5, 7, 9]), "v").first()
    assert round(d["sd"], 3) == 2.138 and d["median"] == 4.5
    assert stats.quantiles(series(spark, [1, 2, 3, 4]), "v", [0.5]).first()["value"] == 2.5
    few = stats.pearson(series(spark, [1, 2, 3], [1, 2, 3], names="x y"), "x", "y").first()
    assert few["r"] is None and few["n"] == 3
    flat = stats.pearson(series(spark, [1] * 10, range(10), names="x y"), "x", "y").first()
    assert flat["r"] is None


def test_step_is_found(spark):
    r = np.random.default_rng(10)
    v = np.r_[r.normal(0, 1, 60), r.normal(4, 1, 60)]
    one = breaks.single_change_point(series(spark, v), "v").first()
    assert one["d"] == DAY0 + dt.timedelta(days=60) and one["bic_gain"] > 0
    many = breaks.change_points(series(spark, v), "v").collect()
    assert [x["d"] for x in many] == [one["d"]]
    assert not breaks.change_points(series(spark, v[:12]), "v").first()["ok"]
    assert breaks.single_change_point(series(spark, r.normal(size=100)), "v").count() == 0


def test_best_split_without_gain(spark):
    v = np.random.default_rng(12).normal(size=100)
    errors = [v[:i].var() * i + v[i:].var() * (100 - i) for i in range(10, 91)]
    i = 10 + int(np.argmin(errors))
    assert breaks.single_change_point(series(spark, v), "v").count() == 0
    one = breaks.single_change_point(series(spark, v), "v", gained=False).first()
    assert one["d"] == DAY0 + dt.timedelta(days=i) and np.allclose([one["before"], one["after"]], [v[:i].mean(), v[i:].mean()])
    assert one["bic_gain"] < 0 and np.isclose(one["bic_gain"], -(100 * np.log(min(errors) / (v.var() * 100)) + 2 * np.log(100)))


def test_cusum_against_plain_loop(spark):
    r = np.random.default_rng(11)
    v = [None if i % 17 == 3 else float(x) for i, x in enumerate(np.r_[r.normal(0, 1, 40), r.normal(2, 1, 40)])]
    got = breaks.cusum(series(spark, v), "v", reference=40).orderBy("d").collect()
    base = [x for x in v[:40] if x is not None]
    m, s = np.mean(base), np.std(base, ddof=1)
    hi = lo = 0.0
    for x, g in zip(v, got, strict=True):
        if x is not None:
            hi, lo = max(0, hi + (x - m) / s - 0.5), max(0, lo - (x - m) / s - 0.5)
        signal = None if x is None else "high" if hi > 5 else "low" if lo > 5 else None
        assert math.isclose(g["high"], hi, abs_tol=1e-9) and math.isclose(g["low"], lo, abs_tol=1e-9) and g["signal"] == signal
        hi, lo = (0.0 if signal == "high" else hi), (0.0 if signal == "low" else lo)
    assert any(g["signal"] == "high" for g in got)


def test_wave_period(spark):
    v = [math.sin(2 * math.pi * i / 7) if i % 3 else None for i in range(140)]
    df = spectral.unpivot_series(series(spark, v), ["v"])
    best = spectral.spectral_peaks(spectral.lomb_scargle(df, "t", "v", keys=["series"]), ["series"]).first()
    assert abs(best["period"] - 7) < 0.1 and best["weekly"] and best["fap"] < 1e-6


def test_density_shapes(spark):
    r = np.random.default_rng(12)
    two = series(spark, np.r_[r.normal(0, 1, 150), r.normal(7, 1, 150)])
    curve = density.kernel_density(two, "v")
    x = [(p["x"], p["y"]) for p in curve.orderBy("i").collect()]
    assert abs(sum(y for _, y in x) * (x[1][0] - x[0][0]) - 1) < 1e-3
    assert density.density_peaks(curve).count() >= 2
    h = density.histogram(two, "v").collect()
    assert sum(b["cnt"] for b in h) == 300 and abs(sum(b["density"] * (b["to"] - b["from"]) for b in h) - 1) < 1e-9
    assert density.histogram(two, "v", 1000).count() == 60
    flat = density.histogram(series(spark, [3.0] * 20), "v").collect()
    assert len(flat) == 1 and flat[0]["cnt"] == 20 and flat[0]["density"] == 0
    assert density.modality(two, "v", replicates=40).first()["p"] < 0.1
    assert density.modality(series(spark, r.normal(size=200)), "v", replicates=40).first()["p"] > 0.1
    gap = density.support_gaps(two, "v", 0.1).collect()
    assert all(g["share"] >= 0.1 for g in gap)


def test_binscatter_and_loess(spark):
    n = 103
    df = series(spark, [3 + 2 * i for i in range(n)], range(n), names="y x")
    bins = smooth.binscatter(df, "x", "y", order="d").collect()
    assert len(bins) == 20 and {b["n"] for b in bins} <= {5, 6} and sum(b["n"] for b in bins) == n
    ranks = {b["bin"]: (b["x_low"], b["x_high"]) for b in bins}
    assert all(ranks[b] == ((b * n) // 20, ((b + 1) * n) // 20 - 1) for b in ranks)
    assert all(abs(p["y"] - (3 + 2 * p["x"])) < 1e-6 for p in smooth.loess(df, "x", "y", order="d").collect())
    assert smooth.loess(df.limit(2), "x", "y").count() == 0


def test_explorer(spark):
    T, S = explorer.Term, explorer.Specification
    s = S("recovery", (T("strain", 1), T("recovery"), T("strain", 1), T("hrv", 9)), (T("strain", 1), T("rhr")))
    assert s.normalized() == S("recovery", (T("strain", 1),), (T("rhr"),))
    assert S("a", (T("x", 1), T("y"))).key() == S("a", (T("y"), T("x", 1))).key()
    r = np.random.default_rng(13)
    x = r.normal(size=300)
    y = np.r_[0, -2 * x[:-1]] + r.normal(size=300)
    df = series(spark, y, x, names="recovery strain")
    out = explorer.run_specification(df, S("recovery", (T("strain", 1),)), [("other", "t", 0.9)], "d").collect()
    term = next(o for o in out if o["role"] == "regressor")
    assert abs(term["coef"] + 2) < 0.2 and term["q"] >= term["p"] and term["family_tests"] == 2
    ledger = explorer.record_run(explorer.clear_family(spark), S("recovery", (T("strain", 1),)), spark.createDataFrame([("regressor", "x", 0.1)], "role string, term string, p double"))
    assert explorer.record_run(ledger, S("recovery", (T("strain", 1),)), spark.createDataFrame([("regressor", "x", 0.2)], "role string, term string, p double")).count() == 1
    assert explorer.parse_preset({"name": "a", "dependent": "nope"}) is None
    assert explorer.parse_preset({"name": "a", "dependent": "recovery", "regressors": [{"field": "strain", "lag": 8}]}) is None
    ok = explorer.parse_preset({"name": " a ", "dependent": "recovery", "regressors": [{"field": "strain", "lag": 1}], "saved_at": 3})
    assert ok["name"] == "a"


def test_presets_round_trip(spark, tmp_path):
    make = lambda n, at: explorer.parse_preset({"name": n, "dependent": "recovery", "regressors": [{"field": "strain", "lag": 1}], "saved_at": at})
    explorer.save_presets(spark, [make("old", 1), make("new", 2)], f"file://{tmp_path}/p")
    assert [p["name"] for p in explorer.load_presets(spark, f"file://{tmp_path}/p")] == ["new", "old"]


def test_packing_invariant():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 9)
        spans, on = [r.choice([3, 4, 6, 8, 12]) for _ in range(n)], [r.random() < 0.7 for _ in range(n)]
        placed = layout.pack(spans, on)
        rows = {}
        for (row, width), state in zip(placed, on, strict=True):
            rows.setdefault(row, []).append((width, state))
        assert all(sum(w for w, _ in members) == 12 and len({s for _, s in members}) == 1 for members in rows.values())
    assert layout.pack([4, 4], [False, False]) == [(0, 6), (0, 6)]


def test_streaks(spark):
    got = metrics.streaks(series(spark, [70, 80, 10, 90, None, 68]), "v", 67, "d").orderBy("first").collect()
    assert [x["length"] for x in got] == [2, 1, 1]


@pytest.mark.parametrize("kind", ["range", "window", "date"])
def test_switch_on(spark, kind):
    size, total = {"range": (30, 500), "window": (365, 400), "date": (365, 100)}[kind]
    row = stats.switch_on(spark.createDataFrame([(10, 150, size, total, DAY0)], "missing long, min_n long, size long, total long, today date")).first()
    assert row["kind"] == kind and (row["d"] is not None) == (kind == "date")
