"""Sparse logistic regression on hashed features, for bounded samples of labelled rows.

Used by the classifiers of this package: features are made in Arrow batches
on the executors; only a sample whose size is a parameter reaches the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, per_class: int, where: Column | None = None
                    ) -> tuple[DataFrame, dict[int, float]]:
    """Texts of at most ``per_class`` rows of each class, in hash order, and each class's weight.

    The weight is the number of labelled rows that a sampled row stands for.
    A document with several labels has the largest; null labels and ids are
    left out. The sample has a fixed bound, so the documents are joined to it
    where they are read, without a shuffle of texts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if where is not None:
        rows = rows.filter(where)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(target))
    picked = [rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(sample, "doc_id"), {y: n / min(n, per_class) for y, n in known.items()}


class Sample:
    """Labelled rows of feature indices, and values (column ``val``, 1 without it), in the order of their ids.

    The features stay where they are; the rows' ranges are what is ordered.
    """

    def __init__(self, table: pa.Table, weights: dict[int, float]) -> None:
        ids, y = (table.column(c).to_numpy() for c in ("doc_id", "y"))
        order = np.lexsort((y, ids))
        self.y = y[order].astype(np.float64)
        self.weight = np.array([weights.get(int(v), 1.0) for v in self.y])
        sizes = np.concatenate([np.zeros(0, np.int64), *[c.value_lengths().to_numpy(zero_copy_only=False) for c in table.column("idx").chunks]])
        self.begin, self.size = (np.cumsum(sizes) - sizes)[order].astype(np.int64), sizes[order].astype(np.int64)
        self.idx = self._flat(table, "idx", np.int32)
        self.val = self._flat(table, "val", np.float32) if "val" in table.column_names else None

    @staticmethod
    def _flat(table: pa.Table, column: str, kind) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy(zero_copy_only=False) for c in table.column(column).chunks]])

    def __len__(self) -> int:
        return len(self.y)

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices, values, row of each) of some rows."""
        n = self.size[at]
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[at], n)
        idx = self.idx[flat]
        return idx, np.ones(len(idx), np.float32) if self.val is None else self.val[flat], np.repeat(np.arange(len(at)), n)


def fit(sample: Sample, at: np.ndarray, scale: np.ndarray, *, l2: float, rounds: int, rate: float = 0.1, batch: int = 64
        ) -> tuple[np.ndarray, float]:
    """Weights and bias by Adagrad over mini-batches; ``scale`` multiplies each feature."""
    dim, rng = len(scale), np.random.default_rng(7)
    w, seen = np.zeros(dim), np.full(dim, 1e-8)
    mean = np.average(sample.y[at], weights=sample.weight[at]) if len(at) else 0.5
    bias = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    seen_bias = 1e-8
    for _ in range(rounds):
        order = rng.permutation(at)
        for k in range(0, len(order), batch):
            part = order[k:k + batch]
            idx, val, row = sample.rows(part)
            x = val * scale[idx]
            z = np.bincount(row, x * w[idx], len(part)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - sample.y[part]) * sample.weight[part] / sample.weight[part].sum()
            grad = np.bincount(idx, x * err[row], dim)
            touched = np.flatnonzero(grad)
            g = grad[touched] + l2 * w[touched]
            seen[touched] += g * g
            w[touched] -= rate * g / np.sqrt(seen[touched])
            seen_bias += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(seen_bias)
    return w * scale, bias


def decision(sample: Sample, at: np.ndarray, w: np.ndarray, bias: float, batch: int = 64) -> np.ndarray:
    z = np.full(len(at), bias)
    for k in range(0, len(at), batch):
        idx, val, row = sample.rows(at[k:k + batch])
        z[k:k + batch] += np.bincount(row, val * w[idx], len(at[k:k + batch]))
    return z


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through out-of-fold scores, with Platt's smoothed targets."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit_calibrated(sample: Sample, dim: int, scale_of, *, folds: int = 3, **how) -> tuple[np.ndarray, float]:
    """Weights and bias whose logistic is a calibrated probability.

    The curve comes from scores of rows that a fold's fit has not seen.
    ``scale_of(rows)`` gives the feature scales learned from those rows.
    Without rows of both classes the score is the (smoothed) class share.
    """
    every = np.arange(len(sample))
    if len(set(sample.y.tolist())) < 2:
        share = (sample.weight[sample.y == 1].sum() + 1) / (sample.weight.sum() + 2)
        return np.zeros(dim), float(np.log(share / (1 - share)))
    z = np.zeros(len(sample))
    fold = np.empty(len(sample), np.int64)
    for y in (0, 1):  # every fold has its share of each class
        own = np.flatnonzero(sample.y == y)
        fold[own] = np.arange(len(own)) % folds
    for k in range(folds):
        rest, held = every[fold != k], every[fold == k]
        if len(held):
            z[held] = decision(sample, held, *fit(sample, rest, scale_of(rest), **how))
    a, b = platt(z, sample.y, sample.weight)
    w, bias = fit(sample, every, scale_of(every), **how)
    return w * a, bias * a + b
