"""Least squares over any number of rows of any number of entities.

First pass: every task turns its rows of ``[design, outcome]`` into a triangular
factor, and the factors of an entity are factored again in a tree of two rounds.
The root, a square of as many columns as the design has, is solved by pivoted QR,
which sees the same column norms as the rows would show.

Second pass: scores are summed in the same way.  For HC1, and for a bandwidth of
zero, each row counts alone.  Otherwise the scores of one day are summed first,
days are dealt into blocks with a halo of the bandwidth behind each, and a
block's lagged products are made where the earlier day lies in the block, so
every pair of days is counted once.

No task holds more than a batch of rows, a block of days or a few hundred
factors, and nothing but the result leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..sources.scratch import materialize

NONE: Sequence[str] = ()
#: Entities whose factors a task holds before it hands them on.
HELD = 512
#: Groups of factors in the first round of the tree.
SLOTS = 64
#: Days of a block at least.
BLOCK = 1024

_PART = "key string, slot long, v array<double>"
_WHOLE = "key string, v array<double>"


def key_json(keys: Sequence[str]) -> Column:
    """An entity's keys as one string; nulls are left out of it."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def with_keys(df: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    """The columns of ``df`` behind the keys that its ``key`` stands for, typed as in ``like``."""
    rest = [c for c in df.columns if c != "key"]
    if not keys:
        return df.select(*rest)
    types = ", ".join(f"`{k}` {like.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(F.from_json("key", types).alias("__k"), *rest).select(*[F.col("__k").getField(k).alias(k) for k in keys], *rest)


def summed_by_task(rows: DataFrame, columns: Sequence[str], part: Callable[[np.ndarray], np.ndarray], add: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """``_PART`` of rows ``key, *columns``: each task's contribution to its entities."""
    columns = list(columns)

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = TaskContext.get().partitionId()
        held: dict[str, np.ndarray] = {}
        out = lambda: pd.DataFrame({"key": list(held), "slot": slot, "v": list(held.values())})
        for batch in batches:
            values = batch[columns].to_numpy(float)
            for key, at in batch.groupby("key", sort=False).indices.items():
                own = part(values[at])
                held[key] = add([held[key], own]) if key in held else own
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.select("key", *columns).mapInPandas(run_task, _PART)


def gathered(parts: DataFrame, add: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """``_WHOLE``, a row for each entity of ``_PART``, in two rounds: no group holds more than a 64th of the tasks' parts."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "v": [add([np.asarray(v, float) for v in pdf["v"]])]})

    some = parts.groupBy("key", F.pmod("slot", F.lit(SLOTS)).alias("slot")).applyInPandas(fold, _WHOLE)
    return some.groupBy("key").applyInPandas(fold, _WHOLE)


def factor_of(values: np.ndarray, present: int) -> np.ndarray:
    """``n``, how many rows show each of the last ``present`` columns but one, and the triangle of the complete rows, flat."""
    width = values.shape[1]
    whole = values[np.isfinite(values).all(axis=1)]
    r = np.zeros((width, width))
    if len(whole):
        top = np.linalg.qr(whole, mode="r")
        r[: len(top)] = top
    shown = values[:, width - 1 - present : width - 1]
    return np.concatenate([[len(whole)], (np.nan_to_num(shown) != 0).sum(axis=0), r.ravel()])


def join_factors(parts: list[np.ndarray], width: int) -> np.ndarray:
    """One factor for the rows of several."""
    head = parts[0].size - width * width
    r = np.zeros((0, width))
    for a in range(0, len(parts), 64):
        r = np.linalg.qr(np.vstack([r, *[p[head:].reshape(width, width) for p in parts[a : a + 64]]]), mode="r")
    return np.concatenate([sum(p[:head] for p in parts), r.ravel()])


def add_arrays(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def block_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """The Bartlett-weighted products of the days of a block with those up to the bandwidth later."""
    span, width, first = int(pdf["span"].iloc[0]), int(pdf["width"].iloc[0]), int(pdf["block"].iloc[0])
    at = pdf["t"].to_numpy(np.int64) - first * span
    s = np.zeros((span + width, len(pdf["s"].iloc[0])))
    s[at] = np.stack(pdf["s"].to_numpy())
    own = s[:span]
    out = own.T @ own
    for gap in range(1, width + 1):
        cross = (1 - gap / (width + 1)) * (own.T @ s[gap : gap + span])
        out += cross + cross.T
    sse = float(pdf["uu"].to_numpy()[at < span].sum())
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "slot": [first], "v": [np.concatenate([[sse], out.ravel()])]})


def fit_models(
    df: DataFrame, keys: Sequence[str], y: str, columns: Sequence[str], make: Callable[[L.Fit], pd.DataFrame], schema: str, kind: str = L.HC1, bandwidth: int | None = None, day: str = "d",
    intercept: bool = True, min_n: int | Callable[[int], int] | None = None, level: float = 0.95, effects: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """What ``make`` gives for each entity's fit of y on the columns, behind the entity's keys.

    Rows with a missing or non-finite value, or without a day where days matter,
    are left out.  Of each group of 0/1 columns in ``effects`` those go that no
    row of the entity shows, and the first that one does.  ``min_n`` may be a
    function of the number of columns asked for.  An entity without rows gives
    nothing.
    """
    keys = list(keys)
    grouped = [c for group in effects for c in group]
    plain = [c for c in columns if c not in grouped]
    design = (["const"] if intercept else []) + plain + grouped
    places = [f"c{i}" for i in range(len(design))]
    value = dict(zip(design, places, strict=True))
    width = len(design) + 1
    number = lambda c: F.col(f"`{c}`").cast("double")
    clock = F.datediff(F.col(day), F.lit("1970-01-01")).cast("long")
    rows = df.select(key_json(keys).alias("key"), clock.alias("t"), *[(F.lit(1.0) if intercept and c == "const" else number(c)).alias(p) for c, p in value.items()], number(y).alias("y"))
    timed = rows.withColumn("y", F.when(F.col("t").isNotNull(), F.col("y")))

    def solve(v: np.ndarray) -> L.Root:
        n, shown, r = int(v[0]), dict(zip(grouped, v[1 : 1 + len(grouped)], strict=True)), v[1 + len(grouped) :].reshape(width, width)
        left_out = {c for group in effects for c in group} - {c for group in effects for c in [c for c in group if shown[c]][1:]}
        own = (["const"] if intercept else []) + [c for c in columns if c not in left_out]
        least = L.least_rows(len(own)) if min_n is None else min_n if isinstance(min_n, int) else min_n(len(own) - intercept)
        at = [design.index(c) for c in own]
        return L.solve_triangle(r[:, [*at, width - 1]], n, own, intercept, least)

    def wide_of(root: L.Root) -> int:
        return L.bandwidth_for(root.n) if bandwidth is None else min(max(0, int(bandwidth)), root.n - 1)

    factors = gathered(summed_by_task(timed, [*places, "y"], lambda v: factor_of(v, len(grouped)), lambda p: join_factors(p, width)), lambda p: join_factors(p, width))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, v in zip(batch["key"], batch["v"], strict=True):
                root = solve(np.asarray(v, float))
                beta = np.zeros(len(design))
                if root.ok:
                    beta[[design.index(root.names[c]) for c in root.kept]] = root.beta
                out.append((key, v, root.ok, beta, wide_of(root) if root.ok and kind == L.HAC else 0))
            yield pd.DataFrame(out, columns=["key", "v", "ok", "beta", "width"])

    roots = materialize(factors.mapInPandas(tell, "key string, v array<double>, ok boolean, beta array<double>, width long"), "fit-roots")
    solved = roots.where("ok").select("key", "beta", "width")
    # Without keys that is one row.
    beside = timed.join(solved, "key") if keys else timed.drop("key").join(F.broadcast(solved))
    whole = F.lit(True)
    for c in [*places, "y"]:
        whole = whole & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    fitted = sum((F.col(p) * F.col("beta")[i] for i, p in enumerate(places)), F.lit(0.0))
    scored = beside.where(whole).withColumn("u", F.col("y") - fitted)
    scores = [F.col(p) * F.col("u") for p in places]
    if kind == L.HAC and (bandwidth is None or bandwidth > 0):
        days = scored.groupBy("key", "t", "width").agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(scores)], F.sum(F.col("u") * F.col("u")).alias("uu"))
        span = F.greatest(F.col("width"), F.lit(BLOCK))
        home = F.floor(F.col("t") / span)
        spread = days.select("key", "t", "width", "uu", F.array(*[f"s{i}" for i in range(len(places))]).alias("s"), span.alias("span"), F.explode(
            F.when(F.col("t") - home * span < F.col("width"), F.array(home, home - 1)).otherwise(F.array(home))).alias("block"))
        products = spread.groupBy("key", "block").applyInPandas(block_products, _PART)
    else:
        products = summed_by_task(scored.select("key", *[s.alias(p) for s, p in zip(scores, places, strict=True)], "u"), [*places, "u"], lambda v: np.concatenate([[float(v[:, -1] @ v[:, -1])], (v[:, :-1].T @ v[:, :-1]).ravel()]), add_arrays)
    meats = gathered(products, add_arrays).select("key", F.col("v").alias("meat"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, v, meat in zip(batch["key"], batch["v"], batch["meat"], strict=True):
                root = solve(np.asarray(v, float))
                fit = L.Fit(False, root.n, root.min_n)
                if root.ok:
                    at = [design.index(root.names[c]) for c in root.kept]
                    m = np.asarray(meat, float)
                    fit = L.fit_of(root, m[1:].reshape(width - 1, width - 1)[np.ix_(at, at)], float(m[0]), kind, wide_of(root), level)
                rows_ = make(fit)
                rows_.insert(0, "key", key)
                out.append(rows_)
            if out:
                yield pd.concat(out, ignore_index=True)

    return with_keys(roots.select("key", "v").join(meats, "key", "left").mapInPandas(finish, f"key string, {schema}"), keys, df)
