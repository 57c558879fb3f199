"""Quality rules: base counts, fixed limits, and a calibrated hashed n-gram classifier.

One narrow pass over whole texts in Arrow batches computes the base counts
and the score: a logistic regression on hashed word n-grams (1-2) and
character n-grams (3-4), each group as shares of its n-grams, trained on
labelled quality rows and calibrated on rows it has not seen. A document is
kept if it passes the base limits and its probability reaches ``THRESHOLD``.

The fit uses at most ``PER_CLASS`` labelled rows of each class, weighted to
the shares of all labelled rows.

Defined cases: null and empty texts have no words and fail; an earlier equal
line is compared byte for byte (by 64-bit hash); repeated rows give a row
each; without labels of both classes the score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import SPACES, WordHasher, blocks, buffers, byte_map, counts_between, mix, text_bytes, word_spans
from kairos.llm.linear import Sample, fit_calibrated, labelled_sample

DIM_BITS = 18
#: Most labelled rows of each class that the fit reads.
PER_CLASS = 2000
#: Base limits: fewest words, largest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
#: Shares of n-grams are multiplied by this, so that weights stay near 1.
SCALE = 50.0

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Measures:
    """Base counts of a block of texts (bytes, each with its closing newline)."""

    def __init__(self) -> None:
        self.hasher, self.lut = WordHasher(), byte_map(SPACES, lower=False)
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(counts, word hashes, first word of each text and one end more)."""
        n = len(off) - 1
        mapped = self.lut[raw]
        s, e = word_spans(mapped, SPACES[0])
        words = self.hasher(raw, s, e)
        first = np.searchsorted(s, off)
        out = {"n_words": np.diff(first)}
        out["word_chars"] = counts_between(np.flatnonzero((mapped != SPACES[0]) & ((raw & 0xC0) != 0x80)), off)
        out["n_symbols"] = counts_between(np.flatnonzero(self.symbol[raw]), off)
        # lines: from after one newline to the next; only those with a word count
        stop = np.flatnonzero(raw == 10)
        start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        has = np.searchsorted(s, stop) > np.searchsorted(s, start)
        start, stop = start[has], stop[has]
        doc = np.searchsorted(off, start, "right") - 1
        out["n_dup_lines"] = self._repeats(self.hasher(raw, start, stop), doc, n, first_too=False)[0]
        # 3-word windows inside a text; every word of a window found again is marked
        at = np.arange(max(len(words) - 2, 0))
        owner = np.repeat(np.arange(n), out["n_words"])
        at = at[owner[at] == owner[at + 2]] if len(at) else at
        with np.errstate(over="ignore"):
            windows = mix(words[at] * np.uint64(3) + mix(words[at + 1] * np.uint64(5) + mix(words[at + 2])))
        again = at[self._repeats(windows, owner[at], n, first_too=True)[1]]
        marked = np.zeros(len(words) + 2, bool)
        for k in range(3):
            marked[again + k] = True
        out["n_repeat_words"] = counts_between(np.flatnonzero(marked), first)
        return out, words, first

    @staticmethod
    def _repeats(h: np.ndarray, doc: np.ndarray, n: int, *, first_too: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per text how many values repeat one of the same text, and where."""
        if not len(h):
            return np.zeros(n, np.int64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.concatenate(([False], same))
        if first_too:
            again[:-1] |= same
        at = order[again]
        return np.bincount(doc[at], minlength=n), at


def _mod(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0xD6E8FEB86659FD93 + 2 * salt)) >> np.uint64(64 - DIM_BITS)).astype(np.int32)


def grams(text: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the word n-grams and of the character n-grams of a text, repeats included."""
    chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        two = words[:-1] * np.uint64(3) + words[1:]
        h = [_mod(words, 1), _mod(mix(two), 2)]
        c = chars[:-2] * np.uint64(0x100000001B3) + chars[1:-1] if len(chars) > 2 else chars[:0]
        c = mix(c * np.uint64(0x100000001B3) + chars[2:]) if len(c) else c
        d = mix(c[:-1] * np.uint64(0x100000001B3) + chars[3:]) if len(c) > 1 else c[:0]
    return np.concatenate(h), np.concatenate([_mod(c, 3), _mod(d, 4)])


def _texts(block: pa.RecordBatch, measures: Measures) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict]]:
    raw, off = buffers(block.column("text"))
    counts, words, first = measures(raw, off)
    for k in range(block.num_rows):
        w, c = grams(raw[off[k]:off[k + 1]].tobytes(), words[first[k]:first[k + 1]])
        yield k, w, c, counts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    measures = Measures()
    for block in blocks(batches):
        idx, val = [], []
        for _, w, c, _ in _texts(block, measures):
            at, n = np.unique(np.concatenate([w, c]), return_counts=True)
            share = np.bincount(np.searchsorted(at, w), minlength=len(at)) / max(len(w), 1)
            share += np.bincount(np.searchsorted(at, c), minlength=len(at)) / max(len(c), 1)
            idx.append(at)
            val.append((share * SCALE).astype(np.float32))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("y"), pa.array(idx, pa.list_(pa.int32())),
                                          pa.array(val, pa.list_(pa.float32()))], ["doc_id", "y", "idx", "val"])


def train(documents: DataFrame, labels: DataFrame, *, target: str = "quality", where: Column | None = None,
          per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights of the buckets and bias, calibrated."""
    texts, weights = labelled_sample(documents, labels, target, per_class, where)
    rows = texts.select("doc_id", "y", text_bytes("text").alias("text")).mapInArrow(
        _features, "doc_id bigint, y int, idx array<int>, val array<float>").toArrow()
    dim = 1 << DIM_BITS
    return fit_calibrated(Sample(rows, weights), dim, lambda _: np.ones(dim), l2=1e-5, rounds=8)


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias), measures = held.value, Measures()
        for block in blocks(batches):
            z, counts = np.zeros(block.num_rows), {}
            for k, w, c, counts in _texts(block, measures):  # noqa: B007
                z[k] = SCALE * (weights[w].sum(dtype=np.float64) / max(len(w), 1) + weights[c].sum(dtype=np.float64) / max(len(c), 1))
            score = 1 / (1 + np.exp(-np.clip(z + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(counts[c], pa.int64()) for c in _BASE],
                                              pa.array(score)], ["doc_id", *_BASE, "score"])
    return run


def rules(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, the base counts, score (probability of quality 1), base_failed and kept, one row per input row."""
    held = documents.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    rows = rows.mapInArrow(_score(held), "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _BASE) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= THRESHOLD)).alias("kept"))
