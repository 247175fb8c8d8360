"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a text are shares and logs that are near to normal. Labelled training rows give, for each class, the sums
of statistics and of their products, all in one aggregation over all such rows; from these come class means and
covariances, shrunk towards the pooled covariance and then towards a multiple of the identity. The Cholesky factor of
each covariance is computed once and goes with the scoring function: a document's score is the logistic of the
difference of its class log densities, from Mahalanobis distances by triangular solves, over a temperature that keeps
far documents apart from one another.

Defined results: a null or empty text has the statistics of ''. Rows without a label train nothing; a doc_id with two
labels trains both. If a class has no training rows, every score is the share of label 1, or one half without rows.
Repeated rows train as often as they are there. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

TO_POOLED, TO_IDENTITY, TEMPERATURE, LEAST_VARIANCE = 0.1, 0.02, 4.0, 1e-4
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
STATISTICS = ("log_words", "log_word_length", "log_line_words", "upper", "digit", "symbol", "stop", "shout", "wide", "distinct_words", "distinct_runs", "distinct_lines", "bare_words", "entropy")


def statistics(text: str) -> np.ndarray:
    data = text.encode()
    n = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    spaces = int(n[9:14].sum() + n[32])
    size, w = max(1, len(data) - spaces), max(1, len(words))
    share = n[n > 0] / max(1, len(data))
    runs = max(1, len(words) - 2)
    letters = sum(1 for x in words if x[:1].isalpha() or x[0] >= 128)
    rare = lambda k: math.log((k + 0.5) / (size + 1))
    return np.array(
        [
            math.log(w),
            math.log(size / w),
            math.log(w / max(1, len(lines))),
            rare(n[65:91].sum()),
            rare(n[48:58].sum()),
            rare(n[SYMBOLS].sum()),
            rare(n[46] + n[44]),
            rare(n[33]),
            n[128:].sum() / size,
            len(set(words)) / w,
            len(set(zip(words, words[1:], words[2:]))) / runs,
            len(set(lines)) / max(1, len(lines)),
            letters / w,
            float(-(share * np.log2(share)).sum()),
        ]
    )


def with_statistics(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Add the column __ef_stats, array<double>."""

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py()) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(flat))

    return docs.withColumn("__ef_stats", of(whole_text(text)))


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray
    #: Lower Cholesky factors of the covariances, and their inverses for products in place of solves.
    factors: np.ndarray
    inverses: np.ndarray
    log_priors: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for k in range(2):
            z = (x - self.means[k]) @ self.inverses[k].T
            logs.append(self.log_priors[k] - 0.5 * (z * z).sum(axis=1) - np.log(np.diagonal(self.factors[k])).sum())
        return logs[1] - logs[0]


def fit(labelled: DataFrame, label: str = "quality", to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant | float:
    """labelled: __ef_stats and the label, 0 or 1. Two rows of sums come to the driver."""
    d, x = len(STATISTICS), F.col("__ef_stats")
    at = lambda i: F.get(x, F.lit(i))
    # Sums about a fixed centre lose no digits to the size of the statistics.
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(d)]
    products = [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {int(r[label]): r for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect()}
    if set(rows) != {0, 1}:
        n = sum(r["n"] for r in rows.values())
        return rows[1]["n"] / n if 1 in rows else (0.0 if n else 0.5)
    counts = np.array([rows[k]["n"] for k in range(2)], dtype=np.float64)
    means = np.array([[rows[k][f"s{i}"] / counts[k] for i in range(d)] for k in range(2)])
    second = np.array([[[rows[k][f"p{max(i, j)}_{min(i, j)}"] / counts[k] for j in range(d)] for i in range(d)] for k in range(2)])
    cov = second - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(counts / counts.sum(), cov, 1)
    cov = (1 - to_pooled) * cov + to_pooled * pooled
    scale = np.diagonal(pooled).clip(LEAST_VARIANCE)
    cov = (1 - to_identity) * cov + to_identity * np.diag(scale) + LEAST_VARIANCE * np.eye(d)
    factors = np.linalg.cholesky(cov)
    inverses = np.array([np.linalg.solve(f, np.eye(d)) for f in factors])
    return Discriminant(means, factors, inverses, np.log(counts / counts.sum()))


def score(docs: DataFrame, model: Discriminant | float, temperature: float = TEMPERATURE) -> DataFrame:
    """docs: with __ef_stats. Adds __ef_score, from 0 to 1, higher where label 1 is likelier."""
    if isinstance(model, float):
        return docs.withColumn("__ef_score", F.lit(model))

    @F.arrow_udf("double")
    def of(stats: pa.Array) -> pa.Array:
        x = stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
        return pa.array(1 / (1 + np.exp(-(model.log_odds(x) / temperature).clip(-700, 700))))

    return docs.withColumn("__ef_score", of(F.col("__ef_stats")))
