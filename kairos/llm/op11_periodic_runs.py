"""Periodic runs of words, found online by catchers over dyadic blocks.

A run is a stretch of words with smallest period q that no neighbouring word
extends; those of at least ``MIN_REPEATS`` periods and ``MIN_WORDS`` words
count. Words are read one after the other:

1. **Blocks.** At level k the blocks of l = 2^k words begin at every multiple
   of l/2. A block that has just been completed gets a catcher.
2. **Catchers.** A catcher looks for the block's next occurrence: each appended
   word advances its longest suffix of the text that begins the block (the
   block's border table says where to go on after a mismatch). The occurrence
   at distance d, l/2 < d <= l, is a new square of period d; a smaller d
   belongs to a lower level, and beyond l the catcher ends.
3. **Runs.** A square extends to the left word by word. It stays open as long
   as appended words repeat those d earlier; later squares of the same period
   merge into the open run.

Why nothing is missed: a run of period q with four periods holds, before its
last q words, a whole block of the level with l/2 < q <= l. The block has at
least q words, so inside the run it cannot recur earlier than q words later
(by Fine and Wilf q would not be the smallest period).

Before that, one vectorised pass over each Arrow block gives every word the
distance to its next occurrence. All but the last q words of a run of period q
recur within q; stretches of so many words that recur within l are rare in
prose, and only they, with the l words that follow, are read by the catchers.
Documents are read once and never shuffled; a text is one task's row.

Words are compared by 64-bit hashes (XXH64 for long ones).

Defined cases: null texts are empty; texts without words have no run and
nothing to collapse; repeated rows give a row each; an empty table gives none;
columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import SPACES, WordHasher, blocks, buffers, byte_map, text_bytes, word_spans

#: A run has at least so many words, and at least so many times its period.
MIN_WORDS, MIN_REPEATS = 6, 4

_RUN = "start:bigint,length:bigint,period:bigint"
_SCHEMA = f"doc_id bigint, n_words bigint, runs array<struct<{_RUN}>>, collapsed string"


def least_length(period: int) -> int:
    return max(MIN_WORDS, MIN_REPEATS * period)


class _Catcher:
    """Looks for the next occurrence of one completed block."""

    __slots__ = ("block", "border", "start", "matched")

    def __init__(self, text: list[int], start: int, size: int) -> None:
        self.start, self.block = start, text[start:start + size]
        self.border = border = [0] * (size + 1)
        block, j = self.block, 0
        for i in range(1, size):
            while j and block[i] != block[j]:
                j = border[j]
            if block[i] == block[j]:
                j += 1
            border[i + 1] = j
        self.matched = j  # the block's own longest border: its next occurrence may overlap it

    def appended(self, word: int, end: int) -> int:
        """Takes the word at ``end - 1``: 0 to go on, the distance of the occurrence, or -1 beyond the block's reach."""
        block, border, j = self.block, self.border, self.matched
        while j and block[j] != word:
            j = border[j]
        if block[j] == word:
            j += 1
        self.matched = j
        if j == len(block):
            return end - j - self.start
        return -1 if end - j - self.start > len(block) else 0


class SquareCatcher:
    """Runs of the words appended so far; ``finish`` closes those that are open."""

    def __init__(self, max_period: int) -> None:
        self.text: list[int] = []
        self.levels = [1 << k for k in range(max(max_period - 1, 0).bit_length() + 1)]
        self.catchers: list[_Catcher] = []
        self.open: dict[int, int] = {}  # period: start
        self.runs: list[tuple[int, int, int]] = []  # start, length, period

    def append(self, word: int) -> None:
        text = self.text
        text.append(word)
        end = len(text)
        for period in [q for q in self.open if text[end - 1 - q] != word]:
            self._close(period, end - 1)
        if self.catchers:
            going = []
            for c in self.catchers:
                found = c.appended(word, end)
                if found == 0:
                    going.append(c)
                elif found > len(c.block) // 2:
                    self._square(c.start, found)
            self.catchers = going
        for size in self.levels:
            if end < size:
                break
            if (end - size) % max(size // 2, 1) == 0:
                self.catchers.append(_Catcher(text, end - size, size))

    def _square(self, start: int, period: int) -> None:
        """A square of ``period`` begins at ``start`` and reaches the last word."""
        if period in self.open:
            return  # merges: the open run covers it
        text = self.text
        while start and text[start - 1] == text[start - 1 + period]:
            start -= 1
        self.open[period] = start

    def _close(self, period: int, end: int) -> None:
        start = self.open.pop(period)
        if end - start >= least_length(period):
            self.runs.append((start, end - start, period))

    def finish(self) -> list[tuple[int, int, int]]:
        for period in list(self.open):
            self._close(period, len(self.text))
        return self.runs


def next_occurrence(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence in the same text (the number of words where there is none)."""
    order = np.lexsort((words, owner)) if len(words) else np.zeros(0, np.int64)  # stable: places ascend
    same = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    gap = np.full(len(words), max(len(words), 1), np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _hopeful(gap: np.ndarray, last: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(first word, end, largest period) of the stretches that may hold runs; ``last`` is the end of each word's text.

    A text's last word never recurs, so a stretch lies in one text.
    """
    found: list[tuple[int, int, int]] = []
    low, high = 1, 1
    while least_length(low) <= longest:
        near = np.concatenate(([False], gap <= high, [False]))
        edge = np.flatnonzero(near[1:] != near[:-1])
        a, b = edge[::2], edge[1::2]
        keep = b - a >= least_length(low) - low
        a, b = a[keep], b[keep]
        found += [(x, y, high) for x, y in zip(a.tolist(), np.minimum(b + high, last[b - 1]).tolist(), strict=True)]
        low, high = high + 1, 2 * high
    return found


def _stretches(gap: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Disjoint stretches inside single texts, with the largest period worth looking for."""
    longest = int(np.diff(first).max(initial=0))
    merged: list[list[int]] = []
    for a, b, period in sorted(_hopeful(gap, first[owner + 1], longest)):
        if merged and a < merged[-1][1]:
            merged[-1][1], merged[-1][2] = max(merged[-1][1], b), max(merged[-1][2], period)
        else:
            merged.append([a, b, period])
    return [tuple(m) for m in merged]


def text_runs(words: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every text of a block; ``first`` has each text's first word and one end more."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    for a, b, period in _stretches(next_occurrence(words, owner), owner, first):
        k = int(owner[a])
        own = np.unique(words[a:b], return_inverse=True)[1].tolist()  # small numbers compare faster
        online = SquareCatcher(min(period, (b - a) // MIN_REPEATS))
        for word in own:
            online.append(word)
        out[k] += [(a - int(first[k]) + s, n, q) for s, n, q in online.finish()]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, lut = WordHasher(), byte_map(SPACES, lower=False)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for block in blocks(batches):
        raw, off = buffers(block.column("text"))
        s, e = word_spans(lut[raw], SPACES[0])
        first = np.searchsorted(s, off)
        owner = np.repeat(np.arange(block.num_rows), np.diff(first))
        runs = text_runs(hasher(raw, s, e), owner, first)
        kept = np.ones(len(s) + 1, np.int64)
        for k, found in enumerate(runs):
            for start, length, period in found:
                kept[first[k] + start + period:first[k] + start + length] = 0
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(np.diff(first), pa.int64()),
             pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], kind),
             pa.array(_joined(raw, s, e, kept[:-1] == 1, first), pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _joined(raw: np.ndarray, s: np.ndarray, e: np.ndarray, kept: np.ndarray, first: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one space."""
    size = np.where(kept, e - s + 1, 0)  # with the space behind it
    ends = np.concatenate(([0], np.cumsum(size)))
    used = np.flatnonzero(kept)
    at = np.arange(int(ends[-1])) - np.repeat(ends[:-1][used] - s[used], size[used])
    out = raw[at]
    out[ends[1:][used] - 1] = 32
    body, bound = out.tobytes(), ends[first].tolist()
    return [body[a:max(b - 1, a)].decode("utf-8", "replace") for a, b in zip(bound[:-1], bound[1:], strict=True)]


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, one row per input row.

    ``collapsed`` has the words, joined by one space, without those that a run
    contains after its first period.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    return rows.mapInArrow(_find, _SCHEMA)


def strongest(runs="runs"):
    """The run with the greatest length / period (exactly); of equals the first, then that of smallest period. Null without runs."""
    c = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(c, F.lit(None).cast(f"struct<{_RUN}>"), lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
