"""Operator 2: quality scores by a regularised quadratic discriminant.

Every whole text becomes a vector of transformed statistics (roots of shares,
logs of counts).  The two classes' means and covariances come from one
aggregation of first and second moments over all labelled rows that are not held
out; the covariances are shrunk towards the pooled one and towards a multiple of
the identity.  A score is the logistic of the difference of the two Gaussian log
densities, whose Mahalanobis terms use Cholesky factors made once with the
model.  The labels, language, source and id of a row are no inputs of its score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, whole_text

FEATURES = (
    "words", "word_length", "upper", "digits", "symbols", "stops", "variety", "top_word", "repeats", "line_variety", "line_words", "stop_words", "bar_words",
)
THRESHOLD = 0.3
HELD_OUT_OF = 5
#: About how many labelled rows ``keep_good`` learns from, where there are more.
FIT_ROWS = 1 << 16
TO_POOLED = 0.10
TO_IDENTITY = 0.1


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; all are finite, also for an empty one."""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    h = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    upper, digits = int(h[65:91].sum()), int(h[48:58].sum())
    letters = upper + int(h[97:123].sum()) + int(h[128:].sum())
    stops = int(h[44] + h[46])
    symbols = int(h[33:127].sum()) - upper - digits - stops - int(h[97:123].sum())
    size = max(1, letters + digits + stops + symbols)
    return [
        np.log1p(len(words)),
        np.log1p(size / n),
        np.sqrt(upper / max(1, letters)),
        np.sqrt(digits / size),
        np.sqrt(symbols / size),
        np.sqrt(min(4.0, stops / n)),
        np.log1p(len(counts)) / np.log1p(n + 1),
        np.sqrt(max(counts.values(), default=0) / n),
        np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        np.sqrt(sum(c for w, c in counts.items() if w[-1] in ".,") / n),
        np.sqrt(counts.get("|", 0) / n),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and the log prior odds."""

    means: np.ndarray
    whiten: np.ndarray
    half_log_det: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        density = [-0.5 * np.square((x - m) @ w.T).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.half_log_det, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def discriminant(n: list[float], first: list[np.ndarray], second: list[np.ndarray], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """The model from each class's count, sums and sums of products.

    With fewer than two rows of a class there is no second density; every score
    then is the share of class 1 (0.5 without any label).
    """
    if min(n) < 2:
        none = np.zeros((0, 0))
        return Discriminant(none, none, none, n[1] / sum(n) if sum(n) else 0.5)
    means = [f / k for f, k in zip(first, n, strict=True)]
    covariance = [s / k - np.outer(m, m) for s, k, m in zip(second, n, means, strict=True)]
    pooled = sum(c * k for c, k in zip(covariance, n, strict=True)) / sum(n)
    scale = np.diag(pooled).mean() or 1.0
    shrunk = [(1 - to_pooled - to_identity) * c + to_pooled * pooled + to_identity * scale * np.eye(len(pooled)) + 1e-9 * np.eye(len(pooled)) for c in covariance]
    factors = [np.linalg.cholesky(c) for c in shrunk]
    return Discriminant(np.array(means), np.array([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]), float(np.log(n[1] / n[0])))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([statistics(t) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **dict(zip(FEATURES, values.T, strict=True))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInPandas(run_task, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def _marks(labels: DataFrame, target: str) -> DataFrame:
    """``doc_id, __y``: one label an id, the largest of several."""
    return labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("__y"))


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", **settings) -> Discriminant:
    """Fit on the rows of ``stats`` that ``labels`` marks and that are not held out: one row of moments for each class."""
    rows = stats.where(~held_out(F.col("doc_id"))).join(_marks(labels, target), "doc_id")
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    sums = [F.count(F.lit(1)).cast("double"), *(F.sum(a) for a in FEATURES), *(F.sum(F.col(a) * F.col(b)) for a, b in pairs)]
    moments = {r[0]: np.array(r[1]) for r in rows.groupBy("__y").agg(F.array(*sums)).collect()}
    d = len(FEATURES)
    n, first, second = [], [], []
    for y in (0, 1):
        m = moments.get(y, np.zeros(1 + d + len(pairs)))
        product = np.zeros((d, d))
        product[np.triu_indices(d)] = m[1 + d :]
        n.append(float(m[0]))
        first.append(m[1 : 1 + d])
        second.append(product + np.triu(product, 1).T)
    return discriminant(n, first, second, **settings)


def apply_model(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = model.score(batch[list(FEATURES)].to_numpy(float))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score, "predicted": (score >= threshold).astype(int)})

    scored = stats.mapInPandas(run_task, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs``.

    Null texts count as empty and are scored as such.  Several labels of one id
    count as their largest; rows without a label, or with a null id, are scored
    but not learnt from.  Other columns are not read; an empty table gives no rows.
    """
    stats = materialize(with_statistics(docs, id_col, text_col), "quality-statistics")
    return apply_model(stats, fit(stats, labels, **settings), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, target: str = "quality", fit_rows: int = FIT_ROWS, **settings) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns.

    The model learns from the labelled rows that are not held out; of more than
    ``fit_rows`` about so many, chosen by a hash of the id, so that their ids fit
    a broadcast and their statistics alone are made for it.  All rows are then
    scored where they lie, so equal ids need no join back.  Null texts count as
    empty, rows with a null id are scored like others, several labels of one id
    count as their largest, without two labelled rows of each class every row
    scores the share of class 1, and an empty table stays empty.
    """
    known = _marks(labels, target).where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"))
    chosen = materialize(known.where(F.pmod(F.xxhash64("__id"), F.lit(max(1, known.count()))) < fit_rows), "quality-learnt")
    learnt = docs.select("doc_id", "text").join(F.broadcast(chosen), docs["doc_id"].cast("long") == chosen["__id"], "left_semi")
    model = fit(with_statistics(learnt), labels, target, **settings)
    good = F.pandas_udf(lambda text: pd.Series(model.score(np.array([statistics(t) for t in text]).reshape(len(text), len(FEATURES))) >= threshold), "boolean")
    return docs.where(good(whole_text()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
