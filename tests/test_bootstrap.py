"""The bootstrap of the modality test against one walk through its random stream."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from tideline.operators import density
from tideline.operators.density import FNV_OFFSET, FNV_PRIME, HASH_SCALE, LCG_PLUS, LCG_TIMES, LEAST_UNIFORM


class Walk:
    """The stream draw by draw."""

    def __init__(self, data):
        state = FNV_OFFSET
        for x in data:
            state = (state ^ (math.floor(x * HASH_SCALE + 0.5) & 0xFFFFFFFF)) * FNV_PRIME & 0xFFFFFFFF
        self.state, self.held = state, []

    def uniform(self):
        self.state = (self.state * LCG_TIMES + LCG_PLUS) & 0xFFFFFFFF
        return self.state / 2**32

    def normal(self):
        if not self.held:
            length, turn = math.sqrt(-2 * math.log(max(LEAST_UNIFORM, self.uniform()))), 2 * math.pi * self.uniform()
            self.held = [length * math.sin(turn), length * math.cos(turn)]
        return self.held.pop()


def walked_modes(v, critical, replicates):
    """Mode counts of all replicates, one after the other."""
    n, sd, mean, walk = len(v), float(np.std(v, ddof=1)), float(v.mean()), Walk(v)
    iqr = float(np.subtract(*np.percentile(v, [75, 25])))
    wide = density.Grid.around(v, density.PAD * max(0.9 * min(sd, iqr / 1.34) * n**-0.2, sd), density.GRID)
    out = []
    for _ in range(replicates):
        draws = [(v[min(n - 1, int(walk.uniform() * n))], walk.normal()) for _ in range(n)]
        picked, noise = np.array(draws).T
        out.append(wide.modes(mean + (picked - mean + critical * noise) / math.sqrt(1 + critical * critical / (sd * sd)), critical))
    return out


@pytest.mark.parametrize("n", [60, 61, 97, 150])
def test_every_replicate_equals_the_walk(n):
    r = np.random.default_rng(n)
    v = np.concatenate([r.normal(-2, 1, n // 2), r.normal(2.2, 1, n - n // 2)])
    assert density.seed_of(v) == Walk(v).state
    found = density.modes_of(v)
    assert [density.replicate_modes(v, k, found["critical"], density.seed_of(v)) for k in range(60)] == walked_modes(v, found["critical"], 60)


def test_jumps_and_draws():
    state = 12345
    walk = [state]
    for _ in range(300):
        walk.append((walk[-1] * LCG_TIMES + LCG_PLUS) & 0xFFFFFFFF)
    assert [density.jump(state, k) for k in range(301)] == walk
    assert (density.uniforms(state, 300) * 2**32).astype(int).tolist() == walk[1:]
    index, normal = density.drawn(state, 0, 75)
    for first in (0, 1, 2, 37, 74):
        i, z = density.drawn(state, first, 75 - first)
        assert (i == index[first:]).all() and (z == normal[first:]).all()


def test_replicates_are_tasks(spark):
    r = np.random.default_rng(8)
    day = dt.date(2024, 1, 1)
    worlds = {"two": np.concatenate([r.normal(-3, 1, 60), r.normal(3, 1, 61)]), "one": r.normal(size=90), None: r.normal(size=61), "few": r.normal(size=12), "flat": np.zeros(80)}
    rows = [(g, day + dt.timedelta(days=i), float(x)) for g, v in worlds.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, d date, v double").repartition(6)
    got = {x["g"]: x for x in density.modality(df, "v", replicates=40, keys=["g"], tasks=9).collect()}
    assert len(got) == 5 and not got["few"]["ok"] and got["few"]["missing"] == 48 and not got["flat"]["ok"] and got["flat"]["p"] is None
    for g in ("two", "one", None):
        exceed = sum(m > 1 for m in walked_modes(worlds[g], got[g]["critical"], 40))
        assert got[g]["p"] == (exceed + 1) / 41 and got[g]["replicates"] == 40
    assert got["two"]["p"] < 0.1 < got["one"]["p"]
