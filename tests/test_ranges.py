"""Windows, control charts and change points of long entities against plain ones."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import breaks, days, ranges, selection, smooth

DAY0 = dt.date(2000, 1, 1)


def panel(spark, series):
    rows = [(g, DAY0 + dt.timedelta(days=i), v) for g, values in series.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, d date, v double").repartition(5)


def entities(seed, sizes):
    r = np.random.default_rng(seed)
    return {g: [None if r.random() < 0.1 else float(x) for x in np.cumsum(r.normal(size=n)) * 0.2 + r.normal(size=n)] for g, n in sizes.items()}


def test_running_numbers_and_sums(spark):
    df = panel(spark, entities(1, {"a": 300, "b": 1, None: 40}))
    got = ranges.running(df, ["g"], ["d"], "n", {"s": F.col("v")}).collect()
    assert len(got) == 341
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["d"])
        assert [r["n"] for r in own] == list(range(1, len(own) + 1))
        before = np.cumsum([0.0] + [r["v"] or 0.0 for r in own])[:-1]
        assert np.allclose([r["s"] for r in own], before)


@pytest.mark.parametrize("width", [1, 7, 28])
@pytest.mark.parametrize("chunk", [28, 50, 1000])
def test_windows_at_every_cut(spark, width, chunk):
    df = panel(spark, entities(2, {"a": 260, "b": 28, "c": 29, None: 57}))
    value = F.col("v")
    mean = lambda w: F.when(F.count(value).over(w) >= max(2, int(0.4 * width)), F.avg(value).over(w))
    got = ranges.over_rows(df, ["g"], ["d"], {"m": lambda f: mean(f(-(width - 1), 0)), "next": lambda f: F.max("v").over(f(1, 1))}, back=27, ahead=1, chunk=chunk)
    plain = df.withColumns({"m": days.rolling_mean(value, width, ["g"], "d"), "next": F.lead("v").over(Window.partitionBy("g").orderBy("d"))})
    key = lambda r: (r["g"] or "", r["d"])
    a, b = sorted(got.collect(), key=key), sorted(plain.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x["d"] == y["d"] and x["next"] == y["next"] and (x["m"] is None) == (y["m"] is None) and (x["m"] is None or math.isclose(x["m"], y["m"], rel_tol=1e-12, abs_tol=1e-12))


def plain_chart(values, k, h, reference=None):
    known = [v for v in (values if reference is None else values[:reference]) if v is not None]
    m, s = np.mean(known), np.std(known, ddof=1)
    z = np.array([math.nan if v is None else (v - m) / s for v in values])
    return z, breaks.chart(z, k, h, 0.0, 0.0)


@pytest.mark.parametrize(("block", "h", "reference"), [(7, 2.0, None), (1, 1.0, 60), (40, 5.0, 100), (10_000, 0.5, None)])
def test_blocks_of_a_chart_equal_the_fold(spark, block, h, reference):
    series = entities(3, {"a": 300, "b": 90, "short": 9}) | {"drift": [0.9 * (i % 50) - 20 + i / 10 for i in range(200)]}
    got = breaks.cusum(panel(spark, series), "v", k=0.5, h=h, reference=reference, keys=["g"], block=block).collect()
    assert {r["g"] for r in got} == {"a", "b", "drift"}
    kinds = set()
    for g in ("a", "b", "drift"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["d"])
        z, (high, low, signal) = plain_chart(series[g], 0.5, h, reference)
        assert np.allclose([math.nan if r["z"] is None else r["z"] for r in own], z, equal_nan=True)
        assert np.allclose([r["high"] for r in own], high) and np.allclose([r["low"] for r in own], low) and [r["signal"] for r in own] == signal
        kinds |= set(signal)
    assert {"high", "low"} <= kinds


def test_effect_of_a_block_is_what_charting_it_gives():
    r = random.Random(5)
    for _ in range(400):
        n, h = r.randrange(1, 40), r.choice([0.5, 1.0, 3.0, 6.0])
        x = np.array([math.nan if r.random() < 0.1 else r.gauss(r.choice([-0.5, 0, 0.6]), 1) for _ in range(n)])
        for s in (0.0, r.random() * h, h):
            state = s
            for v in x.tolist():
                if v == v:
                    state = max(0.0, state + v)
                    state = 0.0 if state > h else state
            assert math.isclose(breaks.after_block(s, *breaks.side(x, h)), state, abs_tol=1e-9)


def split_points(v: np.ndarray, min_segment: int, most: int) -> list[tuple[int, float, float, float]]:
    """Binary segmentation, left halves first until ``most`` points are found: ``(index, before, after, gain)``."""
    s, q = np.r_[0, np.cumsum(v)], np.r_[0, np.cumsum(v * v)]
    found: list[tuple[int, float, float, float]] = []
    todo = [(0, len(v))]
    while todo and len(found) < most:
        a, b = todo.pop()
        n = b - a
        if n < 2 * min_segment:
            continue
        cut = np.arange(a + min_segment, b - min_segment + 1)
        left, right = q[cut] - q[a] - (s[cut] - s[a]) ** 2 / (cut - a), q[b] - q[cut] - (s[b] - s[cut]) ** 2 / (b - cut)
        errors, total = left + right, q[b] - q[a] - (s[b] - s[a]) ** 2 / n
        i = int(np.argmin(errors))
        if total <= 0 or errors[i] <= 0:
            continue
        gain = -(n * math.log(errors[i] / total) + 2 * math.log(n))
        if gain > 0:
            c = int(cut[i])
            found.append((c, (s[c] - s[a]) / (c - a), (s[b] - s[c]) / (b - c), gain))
            todo += [(c, b), (a, c)]
    return sorted(found)


@pytest.mark.parametrize("most", [1, 3, 6])
def test_levels_equal_the_walk(spark, most):
    r = np.random.default_rng(6)
    series = {}
    for e in range(50):
        levels = np.repeat(r.normal(size=r.integers(1, 7)) * 2, r.integers(8, 40))
        series[f"e{e}"] = [None if r.random() < 0.05 else float(v) for v in levels + r.normal(size=len(levels)) * 0.7]
    series["flat"] = [1.0] * 80
    got = breaks.change_points(panel(spark, series), "v", most=most, keys=["g"]).collect()
    splits = 0
    for g, values in series.items():
        seen = [(DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values) if v is not None]
        own = sorted((x for x in got if x["g"] == g), key=lambda x: (x["d"] is not None, x["d"]))
        if len(seen) < 30:
            assert len(own) == 1 and not own[0]["ok"] and own[0]["missing"] == 30 - len(seen)
            continue
        want = split_points(np.array([v for _, v in seen]), 10, most)
        assert [x["d"] for x in own] == [seen[i][0] for i, *_ in want]
        for x, (_, before, after, gain) in zip(own, want, strict=True):
            assert np.allclose([x["before"], x["after"], x["bic_gain"]], [before, after, gain], rtol=1e-6)
        splits += len(want)
    assert splits > 20
    alone = panel(spark, {None: series["e1"]})
    assert breaks.change_points(alone, "v", most=most).count() == max(1 if len([v for v in series["e1"] if v is not None]) < 30 else 0, sum(x["g"] == "e1" for x in got))


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(9)
    groups = {"a": r.normal(size=500), "b": np.repeat([1.0, 2.0, 5.0], [50, 3, 20]), "one": np.array([4.0]), None: 10.0 ** r.uniform(-200, 200, 77), "flat": np.zeros(9)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", math.nan), ("a", None), ("none", math.inf)]
    asked = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = selection.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", asked, ["g"], buckets=16).collect()
    assert len(got) == 5 * len(asked)
    for x in got:
        assert math.isclose(x["quantile"], float(np.quantile(groups[x["g"]], x["probability"])), rel_tol=1e-12) and x["n"] == len(groups[x["g"]])


def test_small_entities_are_sorted_and_large_ones_narrowed(spark, monkeypatch):
    """A value is looked at once a pass, and entities of few values by none."""
    passes = []
    kept = selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda df, label: passes.append(label) or kept(df, label))
    r = np.random.default_rng(19)
    groups = {(1, "a"): r.normal(size=900), (1, None): r.integers(0, 5, 700).astype(float), (None, "b"): r.normal(size=30), (2, "a"): np.zeros(400), (None, None): 10.0 ** r.uniform(-6, 6, 300), (3, "c"): np.array([5.0])}
    rows = [(*g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g int, `h i` string, v double").repartition(4)
    asked = [0.0, 0.25, 0.5, 0.9, 1.0]
    for most in (40, 10_000):
        passes.clear()
        got = selection.exact_quantiles(df, "v", asked, ["g", "h i"], buckets=16, most=most).collect()
        assert len(got) == len(groups) * len(asked)
        for x in got:
            held = groups[x["g"], x["h i"]]
            assert math.isclose(x["quantile"], float(np.quantile(held, x["probability"])), rel_tol=1e-12, abs_tol=1e-300) and x["n"] == len(held)
        assert (len(passes) == 4) == (most == 10_000)
    every = np.concatenate(list(groups.values()))
    for x in selection.exact_quantiles(df, "v", asked, most=40).collect():
        assert math.isclose(x["quantile"], float(np.quantile(every, x["probability"])), rel_tol=1e-12)
    assert selection.exact_quantiles(df.where("false"), "v", asked, ["g"]).count() == 0


def test_local_lines_take_the_nearest_rows(spark):
    """Against sorting all rows for each place, with many equal x on either side."""
    r = np.random.default_rng(10)
    worlds = {"a": r.normal(size=150).round(1), "b": r.integers(0, 4, 40).astype(float), None: r.normal(size=70), "flat": np.ones(8), "few": np.array([1.0, 2.0])}
    rows = [(g, i, float(x), float(np.sin(x) + 0.2 * r.normal())) for g, values in worlds.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double").repartition(5)
    got = smooth.loess(df, "x", "y", 0.35, 25, ["g"], "i").collect()
    assert {x["g"] for x in got} == {"a", "b", None, "flat"}
    for g in ("a", "b", None, "flat"):
        own = [q[1:] for q in rows if q[0] == g]
        n, low, high = len(own), min(q[1] for q in own), max(q[1] for q in own)
        size = max(2, min(n, math.floor(0.35 * n + 0.5)))
        places = sorted((x["x"], x["y"]) for x in got if x["g"] == g)
        assert len(places) == 25
        for k, (gx, y) in enumerate(places):
            assert math.isclose(gx, low + k * (high - low) / 24, abs_tol=1e-12)
            near = sorted(own, key=lambda q: (abs(q[1] - gx), q[1], q[0]))[:size]
            far = max(abs(q[1] - gx) for q in near)
            w = np.array([1.0 if far <= 0 else (1 - (abs(q[1] - gx) / far) ** 3) ** 3 for q in near])
            a, b = np.array([q[1] for q in near]), np.array([q[2] for q in near])
            if w.sum() <= 0:
                assert y == near[0][2]
                continue
            sw, sx, sy = w.sum(), w @ a, w @ b
            sxx, sxy = w @ (a * a) - sx * sx / sw, w @ (a * b) - sx * sy / sw
            slope = 0.0 if abs(sxx) <= 1e-12 * max(1.0, abs(w @ (a * a))) else sxy / sxx
            assert math.isclose(y, sy / sw + slope * (gx - sx / sw), rel_tol=1e-7, abs_tol=1e-7), (g, k)
