"""Integer forms of embedding vectors, shared by the vector operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def scaled_floors(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component, held to the range of a long; the scales are powers of two, so the product is exact."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def matrix(rows: Sequence, width: int) -> np.ndarray:
    """Rows of integers as one matrix; shorter rows end in zeros."""
    if all(len(r) == width for r in rows):
        return np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def magnitude(m: np.ndarray) -> int:
    """The largest absolute value, also of the least long."""
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def to_long(x) -> int:
    return max(-LONG_MAX - 1, min(LONG_MAX, int(x)))
