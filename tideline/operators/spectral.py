"""Periodograms of unevenly observed series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .treefit import key_json, with_keys

NONE: Sequence[str] = ()
#: Grid points on either side that an observation is spread over.
REACH = 14


def independent_frequencies(n: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(-6.362 + 1.193 * n + 0.00098 * n * n))


def false_alarm(power: Column, m: Column) -> Column:
    tail = F.exp(-power)
    return F.when(tail < 1e-8, m * tail).otherwise(1 - F.pow(1 - tail, m))


def power_for_false_alarm(p: float, m: Column) -> Column:
    return -F.ln(F.greatest(F.lit(1e-15), 1 - F.pow(F.lit(1 - p), 1 / m)))


def sums_at(place: np.ndarray, weight: np.ndarray, first: float, step: float, many: int) -> np.ndarray:
    """``sum of weight * exp(-2 pi i f place)`` for ``many`` frequencies f from ``first`` on, ``step`` apart.

    Where places are whole numbers and the step's inverse is one too, these are
    bins of one transform of that length.  Elsewhere each observation is spread
    over an even grid of twice the frequencies by a Gaussian, and the transform of the
    grid is divided by the Gaussian's own.
    """
    turned = weight * np.exp(-2j * math.pi * first * place)
    size = round(1 / step)
    if abs(size * step - 1) < 1e-12 and size >= many and (place == np.floor(place)).all():
        held = np.zeros(size, complex)
        np.add.at(held, np.mod(place.astype(np.int64), size), turned)
        return np.fft.fft(held)[:many]
    # Frequencies are counted from the middle, where the Gaussian's transform is flattest.
    middle, grid = many // 2, max(2 * REACH + 2, 4 * -(-many // 2))
    turn = np.mod(2 * math.pi * step * place, 2 * math.pi)
    turned = turned * np.exp(-1j * middle * turn)
    wide = grid / max(1, many)
    tau = math.pi * REACH / (max(1, many) ** 2 * wide * (wide - 0.5))
    cell = np.floor(turn * grid / (2 * math.pi)).astype(np.int64)
    held = np.zeros(grid, complex)
    for off in range(1 - REACH, REACH + 1):
        gap = turn - 2 * math.pi * (cell + off) / grid
        np.add.at(held, np.mod(cell + off, grid), turned * np.exp(-gap * gap / (4 * tau)))
    k = np.arange(many) - middle
    return math.sqrt(math.pi / tau) * np.exp(tau * k * k) * np.fft.fft(held)[np.mod(k, grid)] / grid


def scargle_power(place: np.ndarray, many: np.ndarray, total: np.ndarray, spread: float, first: float, step: float, count: int) -> np.ndarray:
    """Normalised power at each frequency: ``total`` is a place's sum of values less the mean, ``many`` its number of values."""
    a = sums_at(place, total, first, step, count)
    b = sums_at(2 * place, many.astype(float), first, step, count)
    n, phase = many.sum(), np.arctan2(-b.imag, b.real) / 2
    turned = a * np.exp(1j * phase)
    # With that phase the double angles' sine vanishes, and their cosine is the length.
    cc, ss = (n + np.abs(b)) / 2, (n - np.abs(b)) / 2
    share = lambda x, d: np.divide(x * x, d, out=np.zeros_like(d), where=d > 1e-12 * n)
    return np.maximum(0.0, (share(turned.real, cc) + share(turned.imag, ss)) / (2 * spread))


def lomb_scargle(
    df: DataFrame, t: str, y: str, min_period: float = 2.0, max_period: float | None = None, oversample: int = 5, min_n: int = 30, keys: Sequence[str] = NONE
) -> DataFrame:
    """Scargle's normalised power on a grid of frequencies: ``k, period, power, fap, n``.

    The grid depends on the span alone.  Values are summed by t in one pass; an
    entity's sums, a few numbers for each t, then give all frequencies in
    n log n (``sums_at``).  Where all sines (or cosines) of a frequency are zero,
    as at half a cycle a day on whole days, their part of the power is zero.
    Entities with too few values, no variance or no span give no rows.
    """
    v = S.finite(F.col(y))
    rows = df.where(v.isNotNull() & F.col(t).isNotNull()).select(key_json(keys).alias("key"), F.col(t).cast("double").alias("t"), v.alias("v"))
    summed = rows.groupBy("key", "t").agg(F.count(F.lit(1)).alias("many"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count(F.lit(1))).alias("square"))

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"key": pd.Series([], dtype=str), "k": pd.Series([], dtype=np.int64), "period": [], "power": [], "n": pd.Series([], dtype=np.int64)})
        place, many, mean = pdf["t"].to_numpy() - pdf["t"].min(), pdf["many"].to_numpy(), pdf["mean"].to_numpy()
        n, span = int(many.sum()), float(place.max())
        if n < max(min_n, 2) or span <= 0:
            return none
        centre = float(many @ mean) / n
        spread = (float(pdf["square"].sum()) + float(many @ (mean - centre) ** 2)) / (n - 1)
        first, step = 1 / (float(max_period) if max_period else span / 2), 1 / (span * oversample)
        count = math.floor((1 / float(min_period) + 1e-12 - first) / step) + 1
        if spread <= 0 or count <= 0:
            return none
        power = scargle_power(place, many, many * (mean - centre), spread, first, step, count)
        k = np.arange(count)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "k": k, "period": 1 / (first + k * step), "power": power, "n": n})

    out = summed.groupBy("key").applyInPandas(spectrum, "key string, k long, period double, power double, n long")
    told = out.select("key", "k", "period", "power", false_alarm(F.col("power"), independent_frequencies(F.col("n"))).alias("fap"), "n")
    return with_keys(told, keys, df)


def spectral_peaks(spectrum: DataFrame, keys: Sequence[str], probability: float = 0.05) -> DataFrame:
    """For each series the highest power (the shortest such period) and whether the week stands out."""
    level = power_for_false_alarm(probability, independent_frequencies(F.col("n")))
    weekly = F.max(((F.abs(F.col("period") - 7) < 0.35) & (F.col("power") > level)).cast("int")) == 1
    best = F.max_by(F.struct("period", "power", "fap"), F.struct("power", -F.col("period")))
    return spectrum.groupBy(*keys).agg(best.alias("b"), weekly.alias("weekly")).select(*keys, "b.*", "weekly")


def unpivot_series(days: DataFrame, series: Sequence[str], day: str = "d", keys: Sequence[str] = NONE) -> DataFrame:
    """``keys, series, t, v`` with t in days."""
    long = days.select(*keys, F.datediff(F.col(day), F.lit("1970-01-01")).alias("t"), *[F.col(s).cast("double").alias(s) for s in series])
    return long.unpivot([*keys, "t"], list(series), "series", "v")
