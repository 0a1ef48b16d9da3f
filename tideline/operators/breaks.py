"""Control charts and change points."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import materialize
from . import ranges
from .treefit import key_json, with_keys

NONE: Sequence[str] = ()

_STATES = "slot long, c_high double, d_high double, cuts_high array<double>, outs_high array<double>, c_low double, d_low double, cuts_low array<double>, outs_low array<double>"


def side(x: np.ndarray, h: float) -> tuple[float, float, list[float], list[float]]:
    """What a block does to the sum that comes in: ``(c, d, cuts, outs)``.

    ``x`` are the steps, NaN where a day is missing.  A sum s that makes no
    signal goes out as max(c, s + d).  One above ``cuts[i]`` makes its first
    signal at the i-th of the steps that reach higher than all before; from
    there it starts over, whatever it was, and goes out as ``outs[i]``.  Cuts
    fall; the highest sums signal first.  The last cut is below zero where even
    a sum of zero signals.
    """
    steps = np.nan_to_num(x).tolist()
    observed = (~np.isnan(x)).tolist()
    n = len(steps)
    # The path that starts at zero, over and over.
    path, now, alone = [0.0] * (n + 1), 0.0, n
    for j in range(n):
        now = max(0.0, now + steps[j])
        if observed[j] and now > h:
            alone = min(alone, j)
            now = 0.0
        path[j + 1] = now

    def out_from(j: int) -> float:
        """Where a path that is zero after step j - 1 ends: with the other path, once they meet."""
        state = 0.0
        for i in range(j, n):
            if state == path[i]:
                return path[n]
            state = max(0.0, state + steps[i])
            if observed[i] and state > h:
                state = 0.0
        return state

    cuts, outs, total, highest = [], [], 0.0, -math.inf
    low = now = 0.0
    for j in range(n):
        total += steps[j]
        low = max(0.0, low + steps[j])
        if j == alone:
            cuts.append(-1.0)
            outs.append(out_from(j + 1))
            break
        if observed[j] and total > highest:
            highest = total
            if total > 0:
                cuts.append(h - total)
                outs.append(out_from(j + 1))
    return low, float(np.nansum(x)) if n else 0.0, cuts, outs


def after_block(s: float, c: float, d: float, cuts: Sequence[float], outs: Sequence[float]) -> float:
    for cut, out in zip(cuts, outs, strict=True):
        if s > cut:
            return float(out)
    return max(c, s + d)


def chart(z: np.ndarray, k: float, h: float, high: float, low: float) -> tuple[list[float], list[float], list[str | None]]:
    """Both sums of every day of a block and its signals, from the sums that come in."""
    highs, lows, signals = [], [], []
    for v in z.tolist():
        signal = None
        if v == v:
            high, low = max(0.0, high + v - k), max(0.0, low - v - k)
            signal = "high" if high > h else "low" if low > h else None
        highs.append(high)
        lows.append(low)
        signals.append(signal)
        high, low = 0.0 if signal == "high" else high, 0.0 if signal == "low" else low
    return highs, lows, signals


def cusum(df: DataFrame, x: str, day: str = "d", k: float = 0.5, h: float = 5.0, reference: int | None = None, min_n: int = 21, keys: Sequence[str] = NONE, block: int = ranges.CHUNK) -> DataFrame:
    """Two-sided cumulative sums of standardised values: ``d, z, high, low, signal``.

    Mean and deviation come from the first ``reference`` days (all, where not
    given).  A missing day carries both sums; the side that signals starts over,
    the other goes on.  An entity with fewer than ``min_n`` values, or without
    deviation, gives no rows.

    Both sides can't signal at once (k is not negative), so each is a scan of its
    own: a block's effect on the sum that comes in is a few numbers (``side``),
    an entity's blocks are put together by those, and every block is then
    charted from the sums that do come in.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    rows = df.select(key_json(keys).alias("key"), F.col(day).alias("d"), S.finite(F.col(x)).alias("v"))
    placed = ranges.running(rows, ["key"], ["d"], label="cusum-days")
    first = F.when(F.col("n") <= reference, F.col("v")) if reference is not None else F.col("v")
    base = placed.groupBy("key").agg(F.count("v").alias("n_all"), F.count(first).alias("n_ref"), F.avg(first).alias("m"), F.stddev_samp(first).alias("s"))
    base = base.where((F.col("n_all") >= min_n) & (F.col("n_ref") >= 2) & (F.col("s") > 0)).select("key", "m", "s")
    days = materialize(
        placed.join(base, "key").select("key", F.floor((F.col("n") - 1) / block).alias("slot"), "n", "d", ((F.col("v") - F.col("m")) / F.col("s")).alias("z")), "cusum-z"
    )

    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.sort_values("n")["z"].to_numpy(float)
        up, down = side(z - k, h), side(-z - k, h)
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["slot"].iloc[0], *up, *down)], columns=["key", *[c.split(" ")[0] for c in _STATES.split(", ")]])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        high = low = 0.0
        out = []
        for r in pdf.sort_values("slot").itertuples():
            out.append((r.key, r.slot, high, low))
            high = after_block(high, r.c_high, r.d_high, r.cuts_high, r.outs_high)
            low = after_block(low, r.c_low, r.d_low, r.cuts_low, r.outs_low)
        return pd.DataFrame(out, columns=["of", "at", "high", "low"])

    def charted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        highs, lows, signals = chart(pdf["z"].to_numpy(float), k, h, float(pdf["high"].iloc[0]), float(pdf["low"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"], "d": pdf["d"], "z": pdf["z"], "high": highs, "low": lows, "signal": signals})

    # A row for each block of an entity.
    coming = days.groupBy("key", "slot").applyInPandas(effects, f"key string, {_STATES}").groupBy("key").applyInPandas(states, "of string, at long, high double, low double")
    held = days.join(coming, (F.col("key") == F.col("of")) & (F.col("slot") == F.col("at"))).groupBy("key", "slot").applyInPandas(charted, "key string, d date, z double, high double, low double, signal string")
    return with_keys(held.withColumn("z", F.when(~F.isnan("z"), F.col("z"))), keys, df)


def single_change_point(df: DataFrame, x: str, day: str = "d", min_segment: int = 10, min_n: int = 30, keys: Sequence[str] = NONE, gained: bool = True) -> DataFrame:
    """The one split into two means that gains most: ``d, before, after, bic_gain``; no row where nothing is gained, unless ``gained`` is false.

    Running sums over the observed days give the error of every split at once.
    """
    rows = df.where(S.is_num(F.col(x))).select(*keys, F.col(day).alias("d"), F.col(x).cast("double").alias("v"))
    upto = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    s = rows.withColumns({
        "i": F.row_number().over(Window.partitionBy(*keys).orderBy("d")) - 1, "n": F.count(F.lit(1)).over(whole), "ls": F.coalesce(F.sum("v").over(upto), F.lit(0.0)),
        "lq": F.coalesce(F.sum(F.col("v") * F.col("v")).over(upto), F.lit(0.0)), "ts": F.sum("v").over(whole), "tq": F.sum(F.col("v") * F.col("v")).over(whole),
    })
    right = F.col("n") - F.col("i")
    total = F.col("tq") - F.col("ts") * F.col("ts") / F.col("n")
    sse = F.col("lq") - F.col("ls") * F.col("ls") / F.col("i") + (F.col("tq") - F.col("lq")) - F.pow(F.col("ts") - F.col("ls"), 2) / right
    splits = s.where((F.col("n") >= max(min_n, 2 * min_segment)) & (F.col("i") >= min_segment) & (right >= min_segment)).withColumns({"sse": sse, "total": total})
    best = splits.groupBy(*keys).agg(F.min_by(F.struct("d", "i", "n", "ls", "ts", "sse", "total"), F.struct("sse", "i")).alias("b")).select(*keys, "b.*")
    gain = -(F.col("n") * F.ln(F.col("sse") / F.col("total")) + 2 * F.ln("n"))
    out = best.where((F.col("sse") > 0) & (F.col("total") > 0)).select(
        *keys, "d", (F.col("ls") / F.col("i")).alias("before"), ((F.col("ts") - F.col("ls")) / (F.col("n") - F.col("i"))).alias("after"), gain.alias("bic_gain")
    )
    return out.where("bic_gain > 0") if gained else out


def change_points(df: DataFrame, x: str, day: str = "d", min_segment: int = 10, most: int = 6, min_n: int = 30, keys: Sequence[str] = NONE) -> DataFrame:
    """All change points of each entity: ``ok, n, min_n, missing, d, before, after, bic_gain``.

    An entity with too few observed days is one row with ``ok`` false.  Segments
    are split level by level, all open segments of all entities in one pass over
    the running sums.  Points count in the order of a walk that goes left first,
    the order of their paths from the root, until there are ``most``: at most so
    many segments of an entity are open at a time, and no walk is deeper.
    """
    least = max(min_n, 2 * min_segment)
    value = F.col(x).cast("double")
    rows = df.where(S.is_num(F.col(x))).select(key_json(keys).alias("key"), F.col(day).alias("d"), value.alias("v"))
    placed = ranges.running(rows, ["key"], ["d"], sums={"s": F.col("v"), "q": F.col("v") * F.col("v")}, label="breaks-days")
    held = materialize(placed.select("key", (F.col("n") - 1).alias("i"), "d", "v", "s", "q"), "breaks-sums")
    size = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct((F.col("s") + F.col("v")).alias("s"), (F.col("q") + F.col("v") * F.col("v")).alias("q")), "i").alias("end"))
    sizes = materialize(size, "breaks-sizes")
    zero = F.lit(0.0)
    todo = sizes.where(F.col("n") >= least).select("key", F.lit("").alias("path"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), zero.alias("sa"), zero.alias("qa"), F.col("end.s").alias("sb"), F.col("end.q").alias("qb"))
    found: DataFrame | None = None
    for level in range(most):
        todo = todo.where(F.col("b") - F.col("a") >= 2 * min_segment)
        named = todo.withColumnRenamed("key", "of")
        # Without keys that is at most ``most`` rows.
        near = held.join(named if keys else F.broadcast(named), (F.col("key") == F.col("of")) & (F.col("i") >= F.col("a") + min_segment) & (F.col("i") <= F.col("b") - min_segment)).drop("of")
        left = F.col("q") - F.col("qa") - F.pow(F.col("s") - F.col("sa"), 2) / (F.col("i") - F.col("a"))
        right = F.col("qb") - F.col("q") - F.pow(F.col("sb") - F.col("s"), 2) / (F.col("b") - F.col("i"))
        bounds = ["a", "b", "sa", "qa", "sb", "qb"]
        best = near.groupBy("key", "path", *bounds).agg(F.min(F.struct((left + right).alias("error"), F.col("i").alias("c"), "d", F.col("s").alias("sc"), F.col("q").alias("qc"))).alias("m")).select("key", "path", *bounds, "m.*")
        n = F.col("b") - F.col("a")
        total = F.col("qb") - F.col("qa") - F.pow(F.col("sb") - F.col("sa"), 2) / n
        gain = -(n * F.ln(F.col("error") / total) + 2 * F.ln(n))
        splits = best.where((total > 0) & (F.col("error") > 0)).withColumn("gain", gain).where("gain > 0")
        if found is not None:
            splits = splits.unionByName(found)
        nth = F.row_number().over(Window.partitionBy("key").orderBy("path"))
        # At most twice ``most`` rows an entity.
        found = materialize(splits.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "breaks-found")
        fresh = found.withColumn("nth", nth).where((F.length("path") == level) & (F.col("nth") < most))
        child = lambda name, a, b: F.struct(F.concat("path", F.lit(name)).alias("path"), *[F.col(c).alias(n_) for c, n_ in zip((*a, *b), ("a", "sa", "qa", "b", "sb", "qb"), strict=True)])
        start, middle, end = ("a", "sa", "qa"), ("c", "sc", "qc"), ("b", "sb", "qb")
        todo = materialize(fresh.select("key", F.explode(F.array(child("L", start, middle), child("R", middle, end))).alias("t")).select("key", "t.*"), "breaks-open")
        if todo.isEmpty():
            break
    shown = found.select(
        F.col("key").alias("of"), "d", ((F.col("sc") - F.col("sa")) / (F.col("c") - F.col("a"))).alias("before"), ((F.col("sb") - F.col("sc")) / (F.col("b") - F.col("c"))).alias("after"), F.col("gain").alias("bic_gain")
    )
    all_ = sizes.join(shown, F.col("key") == F.col("of"), "left").where((F.col("n") < least) | F.col("d").isNotNull())
    out = all_.select("key", (F.col("n") >= least).alias("ok"), "n", F.lit(least).cast("long").alias("min_n"), F.greatest(F.lit(0), least - F.col("n")).cast("long").alias("missing"), "d", "before", "after", "bic_gain")
    return with_keys(out, keys, df)
