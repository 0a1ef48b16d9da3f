"""Least squares in numpy for one design: pivoted Householder QR and sandwich covariances."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .student import student_quantile, two_sided_p

RANK_TOLERANCE = 1e-12
HC1, HAC = "hc1", "hac"


def bandwidth_for(n: int) -> int:
    """Newey and West's rule, within the sample."""
    return int(min(max(0, math.floor(4 * (n / 100) ** (2 / 9))), max(0, n - 1)))


def pivoted_qr(x: np.ndarray, y: np.ndarray, tie: float = 0.0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``(R, Q'y, pivots)`` of the columns that add to the rank.

    The next column is the one with the largest residual norm, recomputed each
    time; of equal ones the first in place.  Norms within the share ``tie`` of
    the largest count as equal.
    """
    a, b = x.astype(float).copy(), y.astype(float).copy()
    n, k = a.shape
    pivots = list(range(k))
    limit = RANK_TOLERANCE * max((float(c @ c) for c in a.T), default=0.0)
    rank = 0
    for j in range(min(n, k)):
        norms = np.einsum("ij,ij->j", a[j:, j:], a[j:, j:])
        best = int(np.argmax(norms >= norms.max() * (1 - tie)))
        if norms[best] <= limit:
            break
        if best:
            a[:, [j, j + best]] = a[:, [j + best, j]]
            pivots[j], pivots[j + best] = pivots[j + best], pivots[j]
        v = a[j:, j].copy()
        v[0] += math.copysign(math.sqrt(float(v @ v)), v[0])
        scale = float(v @ v)
        if scale > 0:
            a[j:, j:] -= np.outer(v, 2 / scale * (v @ a[j:, j:]))
            b[j:] -= v * (2 / scale * float(v @ b[j:]))
        rank += 1
    return np.triu(a[:rank, :rank]), b[:rank], pivots[:rank]


@dataclass
class Fit:
    ok: bool
    n: int
    min_n: int
    terms: list[dict] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    k: int = 0
    df: int = 0
    r2: float | None = None
    r2_adjusted: float | None = None
    sigma: float | None = None
    vcov: np.ndarray | None = None
    xtx_inv: np.ndarray | None = None
    kind: str = HC1
    bandwidth: int | None = None
    level: float = 0.95
    fitted: np.ndarray | None = None
    residuals: np.ndarray | None = None
    used: np.ndarray | None = None

    @property
    def missing(self) -> int:
        return max(0, self.min_n - self.n) if not self.ok else 0

    def names(self) -> list[str]:
        return [t["term"] for t in self.terms]


def estimate(name: str, coef: float, variance: float, df: int, level: float) -> dict:
    se = math.sqrt(max(0.0, variance))
    t = coef / se if se > 0 else 0.0
    wide = (student_quantile(1 - (1 - level) / 2, df) if df > 0 else 1.96) * se
    return {"term": name, "coef": coef, "se": se, "t": t, "p": two_sided_p(t, df) if se > 0 else 1.0, "ci_low": coef - wide, "ci_high": coef + wide}


def meat(x: np.ndarray, u: np.ndarray, kind: str, bandwidth: int, times: np.ndarray) -> np.ndarray:
    """Sum of score products: of each row alone, or with Bartlett weights of rows up to ``bandwidth`` apart on the clock."""
    s = x * u[:, None]
    out = s.T @ s
    if kind != HAC or bandwidth <= 0:
        return out
    order = np.argsort(times, kind="stable")
    s, times = s[order], times[order]
    for gap in range(1, len(times)):
        d = times[gap:] - times[:-gap]
        near = d <= bandwidth
        if not near.any():
            break
        w = np.where(near, 1 - d / (bandwidth + 1), 0.0)
        cross = (s[gap:] * w[:, None]).T @ s[:-gap]
        out = out + cross + cross.T
    return out


def least_rows(columns: int) -> int:
    return max(20, 5 * columns)


def ols(
    y: np.ndarray, x: np.ndarray, names: list[str], kind: str = HC1, bandwidth: int | None = None, times: np.ndarray | None = None, intercept: bool = True, min_n: int | None = None, level: float = 0.95
) -> Fit:
    """A regression on the complete rows.  Aliased columns are named in ``dropped``; too few rows are told, not raised."""
    y, x = np.asarray(y, float), np.asarray(x, float).reshape(len(y), -1)
    times = np.arange(len(y), dtype=float) if times is None else np.asarray(times, float)
    keep = np.isfinite(y) & np.isfinite(x).all(axis=1) & np.isfinite(times)
    names = (["const"] if intercept else []) + list(names)
    design = np.column_stack([np.ones(len(y)), x]) if intercept else x
    y, design, times = y[keep], design[keep], times[keep]
    n = len(y)
    least = least_rows(design.shape[1]) if min_n is None else min_n
    if n < least:
        return Fit(False, n, least)
    r, qty, pivots = pivoted_qr(design, y)
    rank = len(pivots)
    if rank == 0 or n - rank < 1:
        return Fit(False, n, max(least, rank + 2))
    inverse = np.linalg.solve(r, np.eye(rank))
    order = np.argsort(pivots)
    kept = [pivots[i] for i in order]
    beta = (inverse @ qty)[order]
    xtx_inv = (inverse @ inverse.T)[np.ix_(order, order)]
    used = design[:, kept]
    fitted = used @ beta
    u = y - fitted
    wide = bandwidth_for(n) if bandwidth is None else min(max(0, int(bandwidth)), n - 1)
    vcov = xtx_inv @ meat(used, u, kind, wide, times) @ xtx_inv * n / (n - rank)
    vcov = (vcov + vcov.T) / 2
    df = n - rank
    sse = float(u @ u)
    centred = intercept and 0 in kept
    sst = float(((y - y.mean()) ** 2).sum()) if centred else float(y @ y)
    r2 = 1.0 if sst == 0 else 1 - sse / sst
    return Fit(
        True, n, least, [estimate(names[c], float(b), float(vcov[i, i]), df, level) for i, (c, b) in enumerate(zip(kept, beta, strict=True))], [names[c] for c in range(len(names)) if c not in kept],
        rank, df, r2, 1 - (1 - r2) * (n - (1 if centred else 0)) / df, math.sqrt(sse / df), vcov, xtx_inv, kind, wide if kind == HAC else None, level, fitted, u, np.flatnonzero(keep),
    )


@dataclass
class Root:
    """What the triangle of ``[design, y]`` tells: coefficients of the columns kept, or too few rows."""

    n: int
    min_n: int
    names: list[str] = field(default_factory=list)
    kept: list[int] = field(default_factory=list)
    beta: np.ndarray | None = None
    xtx_inv: np.ndarray | None = None
    sst: float = 0.0
    centred: bool = False

    @property
    def ok(self) -> bool:
        return self.beta is not None


def solve_triangle(r: np.ndarray, n: int, names: list[str], intercept: bool, least: int) -> Root:
    """Least squares from the triangular factor ``r`` of a design of n complete rows with its outcome as the last column."""
    if n < least:
        return Root(n, least)
    x, y = r[:, :-1], r[:, -1]
    top, qty, pivots = pivoted_qr(x, y, 1e-10)
    rank = len(pivots)
    if rank == 0 or n - rank < 1:
        return Root(n, max(least, rank + 2))
    inverse = np.linalg.solve(top, np.eye(rank))
    order = np.argsort(pivots)
    kept = [pivots[i] for i in order]
    centred = intercept and 0 in kept
    # Beside the constant alone, the outcome's factor is its spread around the mean.
    spread = np.linalg.qr(r[:, [0, -1]], mode="r")[1:, 1] if centred else y
    return Root(n, least, names, kept, (inverse @ qty)[order], (inverse @ inverse.T)[np.ix_(order, order)], float(spread @ spread), centred)


def fit_of(root: Root, meat_: np.ndarray, sse: float, kind: str, bandwidth: int, level: float) -> Fit:
    """A fit from its root and the score products of the columns kept; without fitted values and residuals, which stay with the rows."""
    rank, n = len(root.kept), root.n
    df = n - rank
    vcov = root.xtx_inv @ meat_ @ root.xtx_inv * n / df
    vcov = (vcov + vcov.T) / 2
    r2 = 1.0 if root.sst == 0 else 1 - sse / root.sst
    terms = [estimate(root.names[c], float(b), float(vcov[i, i]), df, level) for i, (c, b) in enumerate(zip(root.kept, root.beta, strict=True))]
    return Fit(
        True, n, root.min_n, terms, [x for c, x in enumerate(root.names) if c not in root.kept], rank, df, r2, 1 - (1 - r2) * (n - (1 if root.centred else 0)) / df, math.sqrt(sse / df),
        vcov, root.xtx_inv, kind, bandwidth if kind == HAC else None, level,
    )


def combination(fit: Fit, weights: dict[str, float], name: str = "combination") -> dict:
    w = np.array([weights.get(t, 0.0) for t in fit.names()])
    beta = np.array([t["coef"] for t in fit.terms])
    return estimate(name, float(w @ beta), float(w @ fit.vcov @ w), fit.df, fit.level)


def ratio(fit: Fit, numerator: str, denominator: str, negate: bool = False) -> dict:
    """A ratio of coefficients by the delta method; refused where a term is missing or the denominator's interval holds zero."""
    by = {t["term"]: (i, t) for i, t in enumerate(fit.terms)}
    if numerator not in by or denominator not in by:
        return {"ok": False, "reason": "missing-term"}
    (i, a), (j, b) = by[numerator], by[denominator]
    if b["ci_low"] <= 0 <= b["ci_high"]:
        return {"ok": False, "reason": "denominator-covers-zero"}
    sign = -1.0 if negate else 1.0
    g = np.zeros(len(fit.terms))
    g[i], g[j] = sign / b["coef"], -sign * a["coef"] / b["coef"] ** 2
    return {"ok": True, "reason": None} | estimate("ratio", sign * a["coef"] / b["coef"], float(g @ fit.vcov @ g), fit.df, fit.level)
