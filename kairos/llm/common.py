"""Shared pieces of the operators: table access, bounded blocks of Arrow batches, word splitting and hashing.

Texts travel to Python workers as bytes with one ``\n`` appended, so that a
concatenated buffer of texts never joins two words of different documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.sources.writers import persist_table, shared_path

#: Bytes of text a worker looks at together (a single longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Rows and bytes of an Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 50_000, 8 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def small_batches(spark: SparkSession) -> None:
    """Set the batch size that text operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    return persist_table(df, f"llm-{name}")


def grows(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: never broadcast, however small it is here, so plans are alike at every size."""
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``shared``, as a table bucketed by ``key``: joins on it don't move the table again."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, f"llm-{name}")
    table_name = f"kairos_{name}_{path.rsplit('-', 1)[1]}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    found = spark.read.table(table_name)  # resolved here, with its buckets
    spark.sql(f"drop table {table_name}")  # the catalog's entry only: the files are outside the warehouse
    return found


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text (null: empty) with the closing newline."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit("\n")).cast("binary")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array without nulls; offsets start at 0."""
    off = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(
        col.type) else np.int32, count=len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    if col.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def trim() -> None:
    """Give freed memory back to the machine: workers keep what they hold while they wait for another task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_bytes`` in ``column``, at least one row each."""
    trim()
    for batch in batches:
        _, off = buffers(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(off, off[row] + max_bytes, "right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end
    trim()


def byte_map(separators: bytes, lower: bool = True) -> np.ndarray:
    """256 entries: a byte's (ASCII lower-cased) value, the first separator for all separators."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(separators)] = separators[0]
    return out


#: Bytes outside words of the class [^\x20\x09-\x0D]+ .
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes outside words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
NON_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def word_spans(mapped: np.ndarray, separator: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a mapped buffer that ends with a separator."""
    inside = mapped != separator
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[::2], edges[1::2]


class WordHasher:
    """64-bit hashes of byte ranges of a buffer, all at once (prefix sums of a polynomial, then mixed).

    A polynomial modulo 2^64 has collisions that can be written down, among structured ranges of 1,024 bytes and more:
    ranges of over ``LONG`` bytes, which are rare among words, get XXH64 one by one instead.
    """

    #: Bytes summed up at a time, so that the sums stay in the processor's cache.
    STRIDE = 1 << 16
    LONG = 256

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(n, _BASE, np.uint64))
                self.down = np.cumprod(np.full(n, _INV, np.uint64))

    def __call__(self, mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        n = len(mapped)
        out = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, n + self.STRIDE, self.STRIDE))
        with np.errstate(over="ignore"):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                low, high = int(starts[a]), int(ends[b - 1])  # ranges are disjoint and sorted
                self._powers(high - low + 1)
                sums = np.empty(high - low + 1, np.uint64)
                sums[0] = 0
                terms = mapped[low:high].astype(np.uint64)
                terms += np.uint64(1)
                terms *= self.up[:high - low]
                np.cumsum(terms, out=sums[1:])
                s, e = starts[a:b] - low, ends[a:b] - low
                out[a:b] = (sums[e] - sums[s]) * self.down[s]
            out = mix(out)
        for k in np.flatnonzero(ends - starts > self.LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(mapped[starts[k]:ends[k]].tobytes())
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def counts_between(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many sorted ``positions`` fall into each of the ranges [bounds[i], bounds[i+1])."""
    at = np.searchsorted(positions, bounds)
    return np.diff(at)
