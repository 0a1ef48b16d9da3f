"""Regressions on the day panel.

Designs (lags, dummies) are built as columns on the spine.  The simple
regressions with robust errors are sums of products and stay relational; the
general fit sums factors and score products over tasks (``treefit``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import scalars as S
from .days import lagged
from .treefit import fit_models

NONE: Sequence[str] = ()
TERMS = "ok boolean, n long, min_n long, missing long, k long, df long, r2 double, r2_adjusted double, sigma double, bandwidth long, dropped array<string>, term string, coef double, se double, t double, p double, ci_low double, ci_high double"
_TERM = ("term", "coef", "se", "t", "p", "ci_low", "ci_high")


def newey_west_bandwidth(n: Column) -> Column:
    return F.least(F.greatest(F.lit(0), F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))), F.greatest(F.lit(0), n - 1)).cast("long")


def simple_ols(df: DataFrame, x: str, y: str, kind: str = L.HC1, day: str = "d", keys: Sequence[str] = NONE) -> DataFrame:
    """Slope of y on x and a constant with HC1 or HAC error: ``coef, se, n, bandwidth``.

    The constant is partialled out.  For HAC each score meets the scores of the
    following days up to the bandwidth; days are numbered, so the pairing is an
    equi-join on the day that each score is looked up for.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    whole = Window.partitionBy(*keys)
    rows = df.where(S.is_num(a) & S.is_num(b)).select(*keys, F.datediff(F.col(day), F.lit("1970-01-01")).cast("long").alias("t"), a.alias("x"), b.alias("y"))
    mean = rows.withColumns({"n": F.count(F.lit(1)).over(whole), "dx": F.col("x") - F.avg("x").over(whole), "dy": F.col("y") - F.avg("y").over(whole)})
    fit = mean.withColumn("sxx", F.sum(F.col("dx") * F.col("dx")).over(whole)).withColumn("b", F.try_divide(F.sum(F.col("dx") * F.col("dy")).over(whole), F.nullif("sxx", F.lit(0.0))))
    score = fit.withColumn("s", F.col("dx") * (F.col("dy") - F.col("b") * F.col("dx")))
    own = score.groupBy(*keys, "n", "sxx", "b").agg(F.sum(F.col("s") * F.col("s")).alias("meat"))
    if kind == L.HAC:
        width = newey_west_bandwidth(F.col("n"))
        ahead = score.withColumn("gap", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), width)))).where(F.col("gap") <= width)
        ahead = ahead.select(*keys, (F.col("t") + F.col("gap")).alias("t"), (F.col("s") * (1 - F.col("gap") / (width + 1))).alias("ws"))
        cross = score.select(*keys, "t", "s").join(ahead, [*keys, "t"]).groupBy(*keys).agg(F.sum(F.col("s") * F.col("ws")).alias("cross"))
        own = own.join(cross, list(keys), "left") if keys else own.join(F.broadcast(cross), how="left")  # one row
        own = own.withColumns({"meat": F.col("meat") + 2 * F.coalesce("cross", F.lit(0.0)), "bandwidth": newey_west_bandwidth(F.col("n"))})
    else:
        own = own.withColumn("bandwidth", F.lit(None).cast("long"))
    se = F.try_divide(F.sqrt(F.try_divide(F.col("meat") * F.col("n"), F.nullif(F.col("n") - 2, F.lit(0)))), F.col("sxx"))
    return own.select(*keys, F.col("b").alias("coef"), se.alias("se"), "n", "bandwidth")


def dummies(df: DataFrame, category: Column, prefix: str, values: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """0/1 columns of all categories, in the order given; a fit leaves out those that it must (``effects``)."""
    names = [f"{prefix}_{v}" for v in values]
    return df.withColumns({n: F.coalesce((category == v).cast("double"), F.lit(0.0)) for n, v in zip(names, values, strict=True)}), names


def weekday_dummies(df: DataFrame, day: str = "d") -> tuple[DataFrame, list[str]]:
    return dummies(df, S.weekday(F.col(day)), "dow", [1, 2, 3, 4, 5, 6, 0])


def month_dummies(df: DataFrame, day: str = "d") -> tuple[DataFrame, list[str]]:
    return dummies(df, S.month0(F.col(day)), "month", range(12))


def term_rows(fit: L.Fit) -> pd.DataFrame:
    base = {
        "ok": fit.ok, "n": fit.n, "min_n": fit.min_n, "missing": fit.missing, "k": fit.k if fit.ok else None, "df": fit.df if fit.ok else None, "r2": fit.r2, "r2_adjusted": fit.r2_adjusted,
        "sigma": fit.sigma, "bandwidth": fit.bandwidth, "dropped": fit.dropped,
    }
    rows = [base | {c: t[c] for c in _TERM} for t in fit.terms] or [base | dict.fromkeys(_TERM)]
    return pd.DataFrame(rows)


def ols(df: DataFrame, y: str, x: Sequence[str], kind: str = L.HC1, bandwidth: int | None = None, day: str = "d", keys: Sequence[str] = NONE, intercept: bool = True, min_n: int | None = None, level: float = 0.95, effects: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The general fit, ``TERMS`` with a row for each term; an entity with too few days is one row with ``ok`` false.

    ``effects`` are groups of 0/1 columns among ``x``, each of which loses its first category.
    """
    return fit_models(df, keys, y, list(x), term_rows, TERMS, kind, bandwidth, day, intercept, min_n, level, effects)


def lag_columns(df: DataFrame, x: str, lags: Sequence[int], day: str = "d", keys: Sequence[str] = NONE) -> tuple[DataFrame, list[str]]:
    names = [f"{x}_lag{k}" for k in lags]
    return df.withColumns({n: lagged(F.col(x), k, 1.0, keys, day) for n, k in zip(names, lags, strict=True)}), names


LAGS = "ok boolean, n long, min_n long, missing long, lag long, coef double, se double, t double, p double, ci_low double, ci_high double, cumulative double, cumulative_se double, cumulative_low double, cumulative_high double"


def distributed_lag(
    df: DataFrame, y: str, x: str, max_lag: int, min_lag: int = 1, controls: Sequence[str] = (), kind: str = L.HAC, bandwidth: int | None = None, day: str = "d", keys: Sequence[str] = NONE,
    min_n: int | None = None, level: float = 0.95, effects: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Effects of x some days before, and their running sums with errors from the whole lag block.

    A window without lags, or one whose lags all drop out, is insufficient.
    """
    lags = list(range(min_lag, max_lag + 1)) if 0 <= min_lag <= max_lag else []
    design, names = lag_columns(df, x, lags, day, keys)

    def make(fit: L.Fit) -> pd.DataFrame:
        fit = fit if names else L.Fit(False, 0, min_n or 1)
        kept = [n for n in names if n in fit.names()]
        base = {"ok": bool(fit.ok and kept), "n": fit.n, "min_n": fit.min_n, "missing": fit.missing}
        rows, so_far = [], {}
        for lag, name in zip(lags, names, strict=True):
            if name not in kept:
                continue
            so_far[name] = 1.0
            total = L.combination(fit, so_far)
            one = next(t for t in fit.terms if t["term"] == name)
            rows.append(base | {"lag": lag} | {c: one[c] for c in _TERM[1:]} | {"cumulative": total["coef"], "cumulative_se": total["se"], "cumulative_low": total["ci_low"], "cumulative_high": total["ci_high"]})
        return pd.DataFrame(rows or [base], columns=[c.split(" ")[0] for c in LAGS.split(", ")])

    return fit_models(design, keys, y, [*names, *controls], make, LAGS, kind, bandwidth, day, True, min_n, level, effects)


RATIO = "ok boolean, n long, min_n long, missing long, reason string, coef double, se double, t double, p double, ci_low double, ci_high double"


def delta_ratio(df: DataFrame, y: str, x: Sequence[str], numerator: str, denominator: str, negate: bool = False, kind: str = L.HC1, day: str = "d", keys: Sequence[str] = NONE, level: float = 0.95) -> DataFrame:
    def make(fit: L.Fit) -> pd.DataFrame:
        r = L.ratio(fit, numerator, denominator, negate) if fit.ok else {"ok": False, "reason": "insufficient"}
        return pd.DataFrame([{"n": fit.n, "min_n": fit.min_n, "missing": fit.missing} | r], columns=[c.split(" ")[0] for c in RATIO.split(", ")])

    return fit_models(df, keys, y, list(x), make, RATIO, kind, day=day, level=level)


def linear_combination(df: DataFrame, y: str, x: Sequence[str], weights: dict[str, float], kind: str = L.HC1, day: str = "d", keys: Sequence[str] = NONE) -> DataFrame:
    def make(fit: L.Fit) -> pd.DataFrame:
        r = {"ok": True} | L.combination(fit, weights) if fit.ok else {"ok": False}
        return pd.DataFrame([{"n": fit.n, "min_n": fit.min_n, "missing": fit.missing, "reason": None} | r], columns=[c.split(" ")[0] for c in RATIO.split(", ")])

    return fit_models(df, keys, y, list(x), make, RATIO, kind, day=day)


def qr_of_partitions(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The triangular factor of a design too long for one group.

    Each task factors its rows and returns a k by k triangle; the triangles are
    factored again in rounds of a tree until one is left.
    """
    columns = list(columns)
    k = len(columns)

    def local(batches):
        r = np.zeros((0, k))
        for b in batches:
            rows = b[columns].to_numpy(float)
            r = np.linalg.qr(np.vstack([r, rows[np.isfinite(rows).all(axis=1)]]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    parts = df.select(*columns).mapInPandas(local, "r array<double>")

    def fold(batches):
        r = np.zeros((0, k))
        for b in batches:
            for v in b["r"]:
                r = np.linalg.qr(np.vstack([r, np.array(v).reshape(-1, k)]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    n = df.sparkSession.sparkContext.defaultParallelism
    while n > 1:
        n = max(1, n // 8)
        parts = parts.repartition(n).mapInPandas(fold, "r array<double>")
    held = [np.array(r[0]).reshape(-1, k) for r in parts.collect()]  # k by k each, one at the end
    return np.linalg.qr(np.vstack(held), mode="r") if held else np.zeros((0, k))
