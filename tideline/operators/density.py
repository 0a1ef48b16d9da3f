"""Histograms, kernel densities, peaks, gaps of support and the test for several modes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize
from .days import meet
from .treefit import key_json, with_keys

NONE: Sequence[str] = ()
MIN_BINS, MAX_BINS = 4, 60
GRID = 512
PAD, CUT = 3.0, 4.0


def spread(df: DataFrame, x: str, keys: Sequence[str] = NONE) -> DataFrame:
    """``n, lo, hi, sd, iqr, h`` of the finite values; h is the rule-of-thumb bandwidth, zero without spread."""
    v = S.finite(F.col(x))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"), F.percentile(v, [0.25, 0.75]).alias("q"))
    iqr = F.coalesce(F.element_at("q", 2) - F.element_at("q", 1), F.lit(0.0))
    sd = F.coalesce("sd", F.lit(0.0))
    least = F.least(sd, iqr / 1.34)
    return out.select(*keys, "n", "lo", "hi", sd.alias("sd"), iqr.alias("iqr"), F.when(F.col("n") > 0, 0.9 * least * F.pow("n", -0.2)).otherwise(0.0).alias("h"))


def histogram(df: DataFrame, x: str, bins: int | None = None, keys: Sequence[str] = NONE) -> DataFrame:
    """``bin, from, to, cnt, density`` of equal bins, empty ones too.

    The width is Freedman and Diaconis's, or gives the root of n bins where the
    quartiles coincide; 4 to 60 bins, also where a number is asked for.  A
    constant series is one bin.
    """
    s = spread(df, x, keys).where("n > 0")
    width = 2 * F.col("iqr") * F.pow("n", -1 / 3)
    auto = F.when(F.col("iqr") > 0, F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(F.ceil(F.sqrt("n")))
    count = F.least(F.lit(MAX_BINS), F.greatest(F.lit(MIN_BINS), auto if bins is None else F.lit(bins))).cast("long")
    flat = F.col("hi") <= F.col("lo")
    shape = s.select(*keys, "n", "lo", F.when(flat, 1).otherwise(count).cast("long").alias("b"), F.when(flat, 0.0).otherwise((F.col("hi") - F.col("lo")) / count).alias("step"))
    v = S.finite(F.col(x))
    rows = df.where(v.isNotNull()).select(*keys, v.alias("v"))
    placed = meet(rows, shape, keys)
    index = F.when(F.col("step") > 0, F.least(F.col("b") - 1, F.floor((F.col("v") - F.col("lo")) / F.col("step")))).otherwise(0).cast("long")
    counts = placed.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    every = shape.select(*keys, "n", "lo", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("bin"))
    cnt = F.coalesce("cnt", F.lit(0))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("from"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("to"), cnt.alias("cnt"),
        F.coalesce(F.try_divide(cnt, F.col("n") * F.nullif("step", F.lit(0.0))), F.lit(0.0)).alias("density"),
    )


def kernel_density(df: DataFrame, x: str, bandwidth: float | None = None, points: int = GRID, keys: Sequence[str] = NONE) -> DataFrame:
    """A Gaussian density on an even grid, three bandwidths beyond the values: ``i, x, y``.

    Each value is shared between its two neighbouring cells, which leaves at
    most ``points`` weighted cells an entity; the kernel, cut at four
    bandwidths, then joins cells with cells.
    """
    s = spread(df, x, keys)
    s = s.withColumn("h", F.lit(bandwidth) if bandwidth else F.col("h")).where("h > 0")
    shape = s.select(*keys, "h", (F.col("lo") - PAD * F.col("h")).alias("g0"), ((F.col("hi") - F.col("lo") + 2 * PAD * F.col("h")) / (points - 1)).alias("step"))
    v = S.finite(F.col(x))
    rows = df.where(v.isNotNull()).select(*keys, v.alias("v"))
    placed = meet(rows, shape, keys).withColumn("pos", (F.col("v") - F.col("g0")) / F.col("step"))
    cell = F.least(F.lit(points - 2), F.floor("pos")).cast("long")
    halves = F.array(F.struct(cell.alias("c"), (1 - (F.col("pos") - cell)).alias("w")), F.struct((cell + 1).alias("c"), (F.col("pos") - cell).alias("w")))
    cells = placed.select(*keys, F.explode(halves).alias("one")).groupBy(*keys, "one.c").agg(F.sum("one.w").alias("w"))
    total = cells.groupBy(*keys).agg(F.sum("w").alias("total"))
    reach = F.ceil(CUT * F.col("h") / F.col("step")).cast("long")
    near = meet(cells, shape, keys).withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - reach), F.least(F.lit(points - 1), F.col("c") + reach))))
    u = (F.col("i") - F.col("c")) * F.col("step") / F.col("h")
    sums = near.groupBy(*keys, "i").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("mass"))
    grid = shape.select(*keys, "h", "g0", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("i"))
    out = grid.join(sums, [*keys, "i"], "left")
    out = meet(out, total, keys)
    y = F.coalesce("mass", F.lit(0.0)) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    return out.select(*keys, "i", (F.col("g0") + F.col("i") * F.col("step")).alias("x"), y.alias("y"))


def density_peaks(curve: DataFrame, keys: Sequence[str] = NONE, floor: float = 1e-3) -> DataFrame:
    """Local maxima above a thousandth of the highest, plateaus at their middle, ends of the curve left out: ``x, y, rank`` by height."""
    w = Window.partitionBy(*keys).orderBy("i")
    runs = curve.withColumn("__new", F.coalesce((F.col("y") != F.lag("y").over(w)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w))
    flat = runs.groupBy(*keys, "__run").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.first("y").alias("y"))
    o = Window.partitionBy(*keys).orderBy("__run")
    top = F.max("y").over(Window.partitionBy(*keys))
    marked = flat.withColumns({"__l": F.lag("y").over(o), "__r": F.lead("y").over(o), "__t": top})
    peaks = marked.where((F.col("y") > F.col("__l")) & (F.col("y") > F.col("__r")) & (F.col("y") > floor * F.col("__t")))
    out = peaks.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("x"), "y")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("y").desc(), "x")).cast("long"))


def support_gaps(df: DataFrame, x: str, min_share: float = 0.1, keys: Sequence[str] = NONE) -> DataFrame:
    """Stretches without values that are wide against the range: ``lo, hi, width, share``, the widest first.

    Values are aggregated to cells narrower than the least gap asked for, so a
    gap lies between the highest value of a cell and the lowest of the next, and
    windows see cells, of which ``min_share`` allows a fixed number.
    """
    v = S.finite(F.col(x))
    cells = max(64, math.ceil(1 / min_share) + 1)
    span = df.groupBy(*keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi")).where("__hi > __lo")
    placed = meet(df.where(v.isNotNull()).select(*keys, v.alias("v")), span, keys)
    cell = F.least(F.lit(cells - 1), F.floor((F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells)).cast("int")
    held = placed.groupBy(*keys, cell.alias("cell"), (F.col("__hi") - F.col("__lo")).alias("__range")).agg(F.min("v").alias("first"), F.max("v").alias("lo"))
    gaps = held.withColumn("hi", F.lead("first").over(Window.partitionBy(*keys).orderBy("cell"))).where("hi is not null")
    gaps = gaps.select(*keys, "lo", "hi", (F.col("hi") - F.col("lo")).alias("width"), ((F.col("hi") - F.col("lo")) / F.col("__range")).alias("share"))
    return gaps.where(F.col("share") >= min_share).orderBy(*keys, F.desc("width"), "lo")


# The offset and prime of the 32-bit FNV-1a hash that seeds the stream, the multiplier and increment of
# the congruential stream, the least uniform that a logarithm is taken of, and the scale at which values are hashed.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
LCG_TIMES, LCG_PLUS = 1664525, 1013904223
LEAST_UNIFORM = 1e-12
HASH_SCALE = 1e6
# Where the search for the critical bandwidth begins and ends, its steps and its tolerance, as multiples of the bandwidth or the deviation.
SEARCH_FROM, SEARCH_TO, SEARCH_STEPS, SEARCH_TOLERANCE = 1 / 64, 4, 40, 1e-4


def seed_of(data: np.ndarray) -> int:
    """The congruential stream's first state, by the values in their order, so a sample always gives the same test."""
    state = FNV_OFFSET
    for scaled in np.floor(np.asarray(data, float) * HASH_SCALE + 0.5).tolist():
        state = (state ^ (int(scaled) & 0xFFFFFFFF)) * FNV_PRIME & 0xFFFFFFFF
    return state


def jump(state: int, steps: int) -> int:
    """The state so many steps later: the step is composed with itself by squaring."""
    times, plus, t, p = 1, 0, LCG_TIMES, LCG_PLUS
    while steps:
        if steps & 1:
            times, plus = times * t & 0xFFFFFFFF, (plus * t + p) & 0xFFFFFFFF
        t, p = t * t & 0xFFFFFFFF, (p * t + p) & 0xFFFFFFFF
        steps >>= 1
    return (state * times + plus) & 0xFFFFFFFF


def uniforms(state: int, many: int) -> np.ndarray:
    """The next draws after a state; what is known is doubled by a jump from each."""
    out = np.array([(state * LCG_TIMES + LCG_PLUS) & 0xFFFFFFFF], np.uint64)
    while len(out) < many:
        times, plus = jump(1, len(out)) - jump(0, len(out)), jump(0, len(out))
        out = np.concatenate([out, (out * np.uint64(times & 0xFFFFFFFF) + np.uint64(plus)) & np.uint64(0xFFFFFFFF)])
    return out[:many] / 2.0**32


def drawn(state: int, first: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Index uniforms and normals of ``many`` draws from the one numbered ``first``.

    Two draws take four uniforms: an index, the two of a pair of normals, and the
    second one's index.
    """
    pairs = first // 2
    u = uniforms(jump(state, 4 * pairs), 4 * ((first + many + 1) // 2 - pairs)).reshape(-1, 4)
    length, turn = np.sqrt(-2 * np.log(np.maximum(LEAST_UNIFORM, u[:, 1]))), 2 * math.pi * u[:, 2]
    index = u[:, [0, 3]].ravel()
    normal = np.column_stack([length * np.cos(turn), length * np.sin(turn)]).ravel()
    skip = first - 2 * pairs
    return index[skip : skip + many], normal[skip : skip + many]


@dataclass(frozen=True)
class Grid:
    """An even grid over a sample and some room beside it."""

    g0: float
    step: float
    points: int

    @classmethod
    def around(cls, v: np.ndarray, pad: float, points: int) -> Grid:
        low, high = float(v.min()) - pad, float(v.max()) + pad
        return cls(low, (high - low if high > low else 1.0) / (points - 1), points)

    def curve(self, v: np.ndarray, h: float) -> np.ndarray:
        """The density of a sample; of values beside the grid's ends the share that falls on it counts."""
        n = self.points
        pos = (v - self.g0) / self.step
        pos = pos[(pos >= -1) & (pos < n)]
        cell = np.floor(pos).astype(int)
        right = pos - cell
        w = np.bincount(cell + 1, 1 - right, n + 2)[1 : n + 1] + np.bincount(cell + 1, right, n + 1)[:n]
        reach = max(1, math.ceil(CUT * h / self.step))
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * self.step / h) ** 2)
        return np.convolve(w, kernel)[reach : reach + n] / (w.sum() * h * math.sqrt(2 * math.pi))

    def modes(self, v: np.ndarray, h: float) -> int:
        return len(_peaks(self.curve(v, h)))


def _peaks(y: np.ndarray, floor: float = 1e-3) -> list[float]:
    """Places of the local maxima, the highest first; a plateau's is its middle, and the ends are none."""
    first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    last = np.r_[first[1:], len(y)] - 1
    flat = y[first]
    inner = np.zeros(len(flat), bool)
    inner[1:-1] = (flat[1:-1] > flat[:-2]) & (flat[1:-1] > flat[2:]) & (flat[1:-1] > floor * y.max())
    at = ((first + last) / 2)[inner]
    return at[np.argsort(-flat[inner], kind="stable")].tolist()


def modes_of(v: np.ndarray, points: int = GRID) -> dict | None:
    """Modes at the rule-of-thumb bandwidth and the least bandwidth with one; None without spread.

    ``p`` is set where no bandwidth has a single mode, and left to the bootstrap
    otherwise.
    """
    n, sd = len(v), float(np.std(v, ddof=1))
    iqr = float(np.subtract(*np.percentile(v, [75, 25])))
    h0 = 0.9 * min(sd, iqr / 1.34) * n**-0.2
    if not (h0 > 0 and sd > 0):
        return None
    around = Grid.around(v, PAD * h0, points)
    y = around.curve(v, h0)
    top = _peaks(y)
    out = {"modes": len(top), "antimode": None, "separation": None, "p": None}
    if len(top) >= 2:
        left, right = sorted(top[:2])
        between = np.arange(math.floor(left) + 1, math.ceil(right))
        low = int(between[np.argmin(y[between])])
        shorter = min(y[math.floor(left)], y[math.floor(right)])
        out |= {"antimode": around.g0 + low * around.step, "separation": 1 - y[low] / shorter}
    wide = Grid.around(v, PAD * max(h0, sd), points)
    lo, hi = SEARCH_FROM * h0, SEARCH_TO * max(h0, sd)
    if wide.modes(v, hi) > 1:
        hi *= SEARCH_TO
        if wide.modes(v, hi) > 1:
            return out | {"critical": hi, "p": 0.0}
    for _ in range(SEARCH_STEPS):
        if hi - lo <= SEARCH_TOLERANCE * h0:
            break
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if wide.modes(v, mid) > 1 else (lo, mid)
    return out | {"critical": hi}


def replicate_modes(v: np.ndarray, replicate: int, critical: float, state: int, points: int = GRID) -> int:
    """Modes of the given replicate of the smoothed bootstrap, rescaled to the sample's variance, at the critical bandwidth."""
    n, sd, mean = len(v), float(np.std(v, ddof=1)), float(v.mean())
    iqr = float(np.subtract(*np.percentile(v, [75, 25])))
    wide = Grid.around(v, PAD * max(0.9 * min(sd, iqr / 1.34) * n**-0.2, sd), points)
    index, noise = drawn(state, replicate * n, n)
    picked = v[np.minimum(n - 1, (index * n).astype(np.int64))]
    shrink = 1 / math.sqrt(1 + critical * critical / (sd * sd))
    return wide.modes(mean + (picked - mean + critical * noise) * shrink, critical)


MODALITY = "ok boolean, n long, min_n long, missing long, modes long, antimode double, separation double, critical double, p double, replicates long"


def modality(df: DataFrame, x: str, min_n: int = 60, replicates: int = 200, points: int = GRID, keys: Sequence[str] = NONE, day: str = "d", tasks: int | None = None) -> DataFrame:
    """The test for each entity: ``ok, n, min_n, missing, modes, antimode, separation, critical, p, replicates``.

    An entity's values, in the order of its days, are one array.  The random
    stream is that of a single walk through all replicates; every replicate
    draws a known number of times, so it jumps to its own first state, and
    replicates are dealt over ``tasks`` (one each, where not given).  Values
    without spread are insufficient.
    """
    v = S.finite(F.col(x))
    rows = df.where(v.isNotNull()).select(key_json(keys).alias("key"), F.col(day).alias("at"), v.alias("v"))

    def observe(pdf: pd.DataFrame) -> pd.DataFrame:
        n, values = len(pdf), pdf.sort_values("at", kind="stable")["v"].to_numpy()
        found = modes_of(values, points) if n >= min_n else None
        rest = found or dict.fromkeys(("modes", "antimode", "separation", "critical", "p"))
        drawing = found is not None and found["p"] is None
        return pd.DataFrame([{
            "key": pdf["key"].iloc[0], "ok": found is not None, "n": n, "min_n": min_n, "missing": max(0, min_n - n), **rest, "state": seed_of(values) if drawing else None, "held": values if drawing else None,
        }])

    seen = materialize(rows.groupBy("key").applyInPandas(observe, "key string, ok boolean, n long, min_n long, missing long, modes long, antimode double, separation double, critical double, p double, state long, held array<double>"), "modality-seen")
    todo = seen.where("state IS NOT NULL").select("key", "held", "state", "critical", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))

    def redraw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            many = [replicate_modes(np.asarray(h, float), r, c, s, points) for h, r, c, s in zip(batch["held"], batch["replicate"], batch["critical"], batch["state"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "modes": many})

    again = todo.repartition(tasks or replicates, "key", "replicate").mapInPandas(redraw, "key string, modes long")
    counts = again.groupBy("key").agg(F.count(F.when(F.col("modes") > 1, 1)).alias("exceed"), F.count(F.lit(1)).alias("done")).withColumnRenamed("key", "of")
    p = F.coalesce("p", (F.col("exceed") + 1) / (F.lit(replicates) + 1))
    out = seen.join(counts, F.col("key") == F.col("of"), "left").select(
        "key", "ok", "n", "min_n", "missing", "modes", "antimode", "separation", "critical", F.when(F.col("ok"), p).alias("p"), F.when(F.col("ok"), F.coalesce("done", F.lit(0))).cast("long").alias("replicates")
    )
    return with_keys(out, keys, df)
