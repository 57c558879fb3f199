"""Toxicity: a character n-gram linear classifier with naive Bayes scaling.

Features are the distinct character n-grams of a text, hashed to ``DIM``
buckets. Each is scaled by its naive Bayes log-count ratio between the two
classes, a logistic regression is fitted on the scaled features and its
scores are calibrated on rows it has not seen. Scoring is one narrow pass in
Arrow batches over whole texts.

The fit uses at most ``PER_CLASS`` labelled rows of each class (weighted to
the shares of all labelled rows); labels, language, source and id are never
inputs of a score.

Defined cases: null texts score as empty ones; every row gets a score, ties
and repeated rows the same one; without labels of both classes the score is
the share of label 1 (0.5 without any); ``keep_clean`` gives back the columns
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import trim, unused
from kairos.llm.linear import Sample, fit_calibrated, labelled_sample

DIM_BITS = 20
#: Lengths of the character n-grams.
ORDERS = (3, 4, 5)
#: Most labelled rows of each class that the fit reads.
PER_CLASS = 2000
#: Documents of the sample that must have a feature for it to count.
MIN_ROWS = 3
THRESHOLD = 0.3
#: Characters of a text that are hashed at once (n-grams across the seams are kept).
PIECE = 1 << 20


class Grams:
    """Distinct hashed character n-grams of a text."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = DIM_BITS) -> None:
        self.orders, self.bits = orders, bits
        self.last = np.zeros(1 << bits, np.int32)

    def _hashed(self, chars: np.ndarray) -> np.ndarray:
        out, h, n = [], chars, 1
        with np.errstate(over="ignore"):
            for order in range(2, max(self.orders) + 1):
                n = len(chars) - order + 1
                if n <= 0:
                    break
                h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + chars[order - 1:]
                if order in self.orders:
                    out.append(((h * np.uint64(0xD6E8FEB86659FD93 + 2 * order)) >> np.uint64(64 - self.bits)).astype(np.int32))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        chars = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        upper = (chars >= 65) & (chars <= 90)
        chars = chars + np.uint64(32) * upper.astype(np.uint64)
        found = []
        for k in range(0, len(chars), PIECE):
            idx = self._hashed(chars[k:k + PIECE + max(self.orders) - 1])
            place = np.arange(len(idx), dtype=np.int32)
            self.last[idx] = place  # the last write of each index stays
            found.append(idx[self.last[idx] == place])
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    trim()
    for batch in batches:
        idx = [grams(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(idx, pa.list_(pa.int32()))],
                                         ["doc_id", "y", "idx"])


def log_count_ratio(sample: Sample, rows: np.ndarray, dim: int, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log ratio of each feature's counts in the two classes; 0 for features of few rows."""
    pos, neg = np.zeros(dim), np.zeros(dim)
    for k in range(0, len(rows), 64):
        idx, _, row = sample.rows(rows[k:k + 64])
        y = sample.y[rows[k:k + 64]][row]
        pos += np.bincount(idx[y == 1], minlength=dim)
        neg += np.bincount(idx[y == 0], minlength=dim)
    p, q = pos + smooth, neg + smooth
    n_pos, n_neg = max((sample.y[rows] == 1).sum(), 1), max((sample.y[rows] == 0).sum(), 1)
    ratio = np.log(p / (n_pos + 2 * smooth)) - np.log(q / (n_neg + 2 * smooth))
    ratio[pos + neg < MIN_ROWS] = 0
    return ratio


def train(documents: DataFrame, labels: DataFrame, *, target: str = "toxic", where: Column | None = None,
          per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights of the n-gram buckets and bias; ``where`` selects the label rows to learn from."""
    texts, weights = labelled_sample(documents, labels, target, per_class, where)
    rows = texts.select("doc_id", "y", "text").mapInArrow(_features, "doc_id bigint, y int, idx array<int>").toArrow()
    sample, dim = Sample(rows, weights), 1 << DIM_BITS
    return fit_calibrated(sample, dim, lambda at: log_count_ratio(sample, at, dim), l2=1e-4, rounds=5)


def scored(documents: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1 in column ``out`` (replaces one of that name)."""
    held = documents.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd
        (w, bias), grams = held.value, Grams()
        z = np.array([w[grams(t)].sum(dtype=np.float64) for t in texts], np.float64) + bias
        trim()
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return documents.withColumn(out, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those scored at ``THRESHOLD`` or more; their columns as they are."""
    name = unused(documents, "toxicity")
    marked = scored(documents, train(documents, labels, where=~held_out()), name)
    return marked.filter(F.col(name) < THRESHOLD).drop(name)
