"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a block of whole documents of one task) gets a suffix array
over its words, sorted by prefix doubling. Every test suffix, cut to the
window, is binary-searched in it, equal ones once: its range of suffixes holds
every place where it occurs. Ranges of one length are disjoint, so the places
of all windows are at most the words of the shard, however repetitive texts
are. A place marks its words as hit and belongs to all items that have the
window; places that go on in the item where a window stands first join into
the longest verbatim match there. Documents are read once and never shuffled;
suffix arrays live in the task that built them, so a lost executor costs a
retry of its shards.

The test items are hashed on the executors into packed blocks of at most
``BLOCK_WORDS`` words (one longer item is a block of its own). The driver
passes them on one at a time; a worker goes through them for each shard with
one in memory, so memory has a fixed bound however many items there are.

Words are compared by 64-bit hashes (XXH64 for long ones).

Defined cases: null or wordless texts have no words, no hits and are not
contaminated; wordless items never match; items shorter than the window are
one window; several items with one id count once; a document row that is
repeated gives a row each time; an empty table of either kind gives no hits;
``decontaminate`` gives back the columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import NON_ALNUM, WordHasher, blocks, buffers, byte_map, text_bytes, unused, word_spans

WINDOW = 13
#: Words of test items that are searched together: 8 bytes a word, so 32 MB in a worker.
BLOCK_WORDS = 4_000_000
#: Text of one shard; its suffix array takes about 10 times as much memory.
SHARD_BYTES = 8 << 20

#: Windows searched, and (document, item) pairs listed, at a time.
CHUNK = 1 << 18

_MATCH = "array<struct<item_id:bigint,item_word:int,doc_word:int,n_words:int>>"
_SCHEMA = f"doc_id bigint, n_words bigint, spans array<struct<s:int,e:int>>, item_ids array<bigint>, matches {_MATCH}"


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array sorted by the first ``depth`` words at least, word ranks, distinct words in rank order)."""
    distinct, rank = np.unique(words, return_inverse=True)
    first = rank.astype(np.int64)
    n, r, k = len(words), first, 1
    order = np.argsort(r, kind="stable") if n else np.zeros(0, np.int64)
    while k < depth and n:
        key = r * (n + 1)
        key[:max(n - k, 0)] += r[k:] + 1
        order = np.argsort(key)
        key = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        r = np.empty(n, np.int64)
        r[order] = step
        k *= 2
        if step[-1] == n - 1:
            break
    return order, first, distinct


def search(order: np.ndarray, rank: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query row (word ranks, ``length`` of them) the range of suffixes that begin with it."""
    n, bounds = len(order), []
    for upper in (False, True):
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), n, np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            at, sign = order[mid], np.zeros(len(open_), np.int8)  # of suffix minus query
            todo = np.arange(len(open_))
            for j in range(query.shape[1]):
                todo = todo[(j < length[open_[todo]])]
                if not len(todo):
                    break
                p = at[todo] + j
                word = np.where(p < n, rank[np.minimum(p, n - 1)], -1)
                wanted = query[open_[todo], j]
                sign[todo] = np.sign(word - wanted)
                todo = todo[word == wanted]
            right = sign <= 0 if upper else sign < 0
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        bounds.append(lo)
    return bounds[0], bounds[1]


def windows_of(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item index) of every window of items laid end to end; ``starts`` has one end more."""
    sizes = np.diff(starts)
    n = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
    item = np.repeat(np.arange(len(sizes)), n)
    first = starts[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    return first, np.minimum(sizes[item], window), item


def _shard_words(block: pa.RecordBatch, hasher: WordHasher, lut: np.ndarray):
    """Word hashes with a zero after each document, and each document's first word and number of words."""
    raw, off = buffers(block.column("text"))
    mapped = lut[raw]
    s, e = word_spans(mapped)
    h = hasher(mapped, s, e)
    h[h == 0] = 1
    n = np.diff(np.searchsorted(s, off))
    first = np.cumsum(n + 1) - (n + 1)
    out = np.zeros(len(h) + len(n), np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, first, n


class _Shard:
    """The suffix array of a block of documents, and what the test items have hit so far."""

    def __init__(self, block: pa.RecordBatch, hasher: WordHasher, lut: np.ndarray, window: int) -> None:
        self.words, self.first, self.n = _shard_words(block, hasher, lut)
        self.order, self.rank, self.distinct = suffix_array(self.words, window)
        self.marks = np.zeros(len(self.words) + 1, np.int64)
        self.items: list[np.ndarray] = []  # rows: document, item number, block number
        self.places: list[np.ndarray] = []  # rows: document, block, item, word of the item, word of the shard, words
        self.ids: list[list] = []

    def search(self, words: np.ndarray, starts: np.ndarray, ids: list, window: int) -> None:
        """Look for the windows of a block of items."""
        k = len(self.ids)
        self.ids.append(ids)
        at = np.searchsorted(self.distinct, words)
        known = at < len(self.distinct)
        known[known] = self.distinct[at[known]] == words[known]
        missing = np.concatenate(([0], np.cumsum(~known)))
        first, size, item = windows_of(words, starts, window)
        live = np.flatnonzero(missing[first + size] == missing[first])  # windows of words that the shard has
        for c in range(0, len(live), CHUNK):
            part = live[c:c + CHUNK]
            j = np.arange(window)[None, :]
            cells = np.where(j < size[part][:, None], at[first[part][:, None] + np.minimum(j, size[part][:, None] - 1)], -1)
            query, lead, back = np.unique(cells, axis=0, return_index=True, return_inverse=True)  # equal windows once
            self._found(query, size[part][lead], part[lead], back.ravel(), item[part], first, item, starts, k)

    def _found(self, query, size, lead, back, owner, first, item, starts, k) -> None:
        lo, hi = search(self.order, self.rank, query, size)
        reps = hi - lo
        hit = np.repeat(np.arange(len(query)), reps)
        if not len(hit):
            return
        place = self.order[np.arange(len(hit)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo, reps)]
        np.add.at(self.marks, place, 1)
        np.add.at(self.marks, place + size[hit], -1)
        doc = np.searchsorted(self.first, place, "right") - 1
        self.places.append(np.column_stack([doc, np.full(len(hit), k), item[lead][hit], first[lead][hit] - starts[item[lead][hit]], place, size[hit]]))
        # items that have a window: (window, item) once, then by window
        have = np.unique(np.column_stack([back, owner]), axis=0)
        begin = np.searchsorted(have[:, 0], np.arange(len(query) + 1))
        pairs = np.unique(np.column_stack([doc, hit]), axis=0)
        each = np.diff(begin)[pairs[:, 1]]
        ends = np.cumsum(each)
        p = 0
        while p < len(pairs):
            q = max(int(np.searchsorted(ends, (ends[p - 1] if p else 0) + CHUNK, "right")), p + 1)
            some, m = pairs[p:q], each[p:q]
            flat = np.repeat(begin[some[:, 1]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            self.items.append(np.unique(np.column_stack([np.repeat(some[:, 0], m), have[flat, 1], np.full(len(flat), k)]), axis=0))
            p = q

    def spans(self) -> list[list[dict]]:
        """Hit words of each document as disjoint sorted spans."""
        inside = np.concatenate(([False], np.cumsum(self.marks[:-1]) > 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]  # a document's last word is followed by a zero that no window covers
        doc = np.searchsorted(self.first, s, "right") - 1
        out: list[list[dict]] = [[] for _ in self.n]
        for d, a, b in zip(doc.tolist(), (s - self.first[doc]).tolist(), (e - self.first[doc]).tolist(), strict=True):
            out[d].append({"s": a, "e": b})
        return out

    def item_ids(self) -> list[list]:
        """Items (by id; null ids left out) found in each document."""
        out: list[list] = [[] for _ in self.n]
        if self.items:
            for d, i, k in np.unique(np.concatenate(self.items), axis=0).tolist():
                if self.ids[k][i] is not None:
                    out[d].append(self.ids[k][i])
        return out

    def matches(self) -> list[list[dict]]:
        """Places on one diagonal of an item that touch or overlap, joined."""
        out: list[list[dict]] = [[] for _ in self.n]
        if not self.places:
            return out
        rows = np.concatenate(self.places)
        rows = rows[np.lexsort((rows[:, 4], rows[:, 4] - rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        key = np.column_stack([rows[:, :3], rows[:, 4] - rows[:, 3]])
        same = np.concatenate(([False], (key[1:] == key[:-1]).all(axis=1)))
        # windows of one item have one size, so on a diagonal later places also end later
        new = ~same | np.concatenate(([True], rows[1:, 4] > (rows[:, 4] + rows[:, 5])[:-1]))
        a = np.flatnonzero(new)
        b = np.concatenate((a[1:], [len(rows)])) - 1
        for (d, k, i, y, x, _), end in zip(rows[a].tolist(), (rows[b, 4] + rows[b, 5]).tolist(), strict=True):
            out[d].append({"item_id": self.ids[k][i], "item_word": y, "doc_word": x - int(self.first[d]), "n_words": end - x})
        return [sorted(m, key=lambda r: (r["doc_word"], r["item_word"])) for m in out]


def _search_shards(queries, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = WordHasher(), byte_map(NON_ALNUM)
        spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        matches = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
        for block in blocks(batches, max_bytes=SHARD_BYTES):
            shard = _Shard(block, hasher, lut, window)
            for held in queries:
                shard.search(*held.value, window)
                if len(queries) > 1:
                    held.__dict__.pop("_value", None)  # it stays on the executor's disk
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(shard.n, pa.int64()), pa.array(shard.spans(), spans),
                 pa.array(shard.item_ids(), pa.list_(pa.int64())), pa.array(shard.matches(), matches)],
                ["doc_id", "n_words", "spans", "item_ids", "matches"])
    return run


def _pack_items(max_words: int):
    """Blocks of items: word hashes end to end, the number of words of each item, and the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lut = WordHasher(), byte_map(NON_ALNUM)
        held, sizes, ids, total = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate([np.zeros(0, np.uint64), *held]).tobytes()], pa.binary()), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([ids], pa.list_(pa.int64()))], ["words", "sizes", "ids"])

        for batch in batches:
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mapped = lut[np.frombuffer(text, np.uint8)]
                h = hasher(mapped, *word_spans(mapped))
                h[h == 0] = 1
                if total and total + len(h) > max_words:
                    yield block()
                    held, sizes, ids, total = [], [], [], 0
                held.append(h)
                sizes.append(len(h))
                ids.append(item_id)
                total += len(h)
        if ids:
            yield block()
    return run


def _item_blocks(items: DataFrame, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Packed blocks of items, one at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes("text").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(-(-size // (8 * max_words)), 1)  # a packed block of a partition is rarely half empty
    packed = rows.repartition(parts).sortWithinPartitions("item_id", "text").mapInArrow(
        _pack_items(max_words), "words binary, sizes array<bigint>, ids array<bigint>")
    for row in packed.toLocalIterator():
        yield np.frombuffer(bytes(row["words"]), np.uint64), np.concatenate(([0], np.cumsum(row["sizes"]))).astype(np.int64), list(row["ids"])


def contamination(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, max_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (distinct, sorted as strings), spans of hit words, longest matches.

    One row per input row. Items with a null id count towards hits and are
    left out of ``item_ids``.
    """
    spark = documents.sparkSession
    queries = [spark.sparkContext.broadcast(b) for b in _item_blocks(items, max_words)]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    found = docs.mapInArrow(_search_shards(queries, window), _SCHEMA)
    return found.select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("item_ids", lambda i: i.cast("string")))).alias("item_ids"), "spans", "matches")


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    """The rule of the contract: at least a twentieth of the words lie in matches."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents`` without the rows that are contaminated; their columns as they are.

    Rows with a null doc_id cannot be told apart afterwards; they stay.
    """
    id_ = unused(documents, "bad_id")
    bad = contamination(documents, items).filter(is_contaminated()).select(F.col("doc_id").alias(id_)).distinct()
    return documents.join(bad, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
