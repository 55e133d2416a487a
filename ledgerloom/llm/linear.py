"""Logistic regression on bounded samples, and samples of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_logistic(
    x: np.ndarray,
    y: np.ndarray,
    penalty: float = 1.0,
    turns: int = 12,
    times: np.ndarray | None = None,
) -> np.ndarray:
    """Weights, the intercept last. One class only, or no rows: the prior alone.

    A row counts ``times``; each once if that is not given.
    """
    weights = np.zeros(x.shape[1] + 1)
    times = np.ones(len(y)) if times is None else times
    if not len(y) or y.min() == y.max():
        weights[-1] = logit(np.array(((y * times).sum() + 0.01) / (times.sum() + 1)))
        return weights
    full = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    ridge = np.full(full.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(turns):
        p = sigmoid(full @ weights)
        step = np.linalg.solve(
            (full * (times * (p * (1 - p) + 1e-9))[:, None]).T @ full + np.diag(ridge),
            full.T @ (times * (y - p)) - ridge * weights,
        )
        weights += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return weights


def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ weights[:-1] + weights[-1])


def hashed_fold(ids: np.ndarray, folds: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(folds)


def sample_rows(rows: DataFrame, most: int, seed: str, *given: Column) -> DataFrame:
    """At most ``most`` rows with each condition, those of the smallest hash of doc_id."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    parts = [rows.filter(g).orderBy(order, "doc_id").limit(most) for g in given or (F.lit(True),)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def label_counts(known: DataFrame, label: str) -> tuple[int, int]:
    """Rows whose label is false, and true."""
    n, n_true = known.agg(F.count(label), F.count_if(label)).first()
    return n - n_true, n_true


def row_times(y: np.ndarray, counts: tuple[int, int], most: int) -> np.ndarray:
    """How much a row counts of which at most ``most`` of either label were sampled.

    The labels have their shares of all ``counts``; on average a row counts once, so that a
    penalty weighs as it did.
    """
    times = np.array([max(1.0, n / most) for n in counts])[(y == 1).astype(int)]
    return times / times.mean() if len(y) else times


def texts_of(docs: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """One row of ``docs`` for each of a bounded number of ids, with the columns of ``ids``."""
    own = [c for c in ids.columns if c != "doc_id"]
    joined = docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id")
    return joined.groupBy("doc_id", *own).agg(
        F.min(F.struct(*columns)).alias("row")
    ).select("doc_id", *own, "row.*")
