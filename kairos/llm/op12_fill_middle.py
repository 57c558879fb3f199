"""Fill-in-the-middle rewriting of documents with a piece table.

A document never gets copied while it is rearranged. A piece table holds two
immutable buffers, the text and the sentinels, and an ordered list of
descriptors (buffer, start, length):

1. a new document is one descriptor over the whole text;
2. **cutting** at an offset splits the descriptor that covers it;
3. an **arrangement** (``ARRANGEMENTS``) permutes the three parts and puts
   sentinel descriptors before them;
4. the **inverse permutation** takes the parts of an output, found between its
   sentinels, back to their order;
5. hashes **stream** the descriptors' bytes; only asking for the text itself
   joins them.

Where a document is cut and which form it gets follows from SHA-256 of a seed
and the document's id, so every run and every retried task decides alike.
Cuts fall between units: the white space before a word together with the
word, or white space that ends the text. Documents are read once and never
shuffled.

Defined cases: null texts are empty; empty texts, and texts that hold a
sentinel, stay plain; a null id decides like an id of no digits; repeated rows
give a row each; an empty table gives none; columns other than ``doc_id`` and
``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kairos.llm.common import SPACES, blocks, buffers, byte_map, text_bytes, word_spans

SEED = 42
#: Percent of documents that are rearranged, and percent of those with the suffix first.
RATE, SUFFIX_FIRST_RATE = 50, 80
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts of each form.
ARRANGEMENTS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")

_TEXT, _SENTINEL = 0, 1


@dataclass(frozen=True)
class Piece:
    """``length`` bytes from ``start`` of one of the two buffers."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """An ordered list of pieces over an immutable text and the sentinels."""

    sentinels = memoryview(b"".join(SENTINELS.values()))
    places = {name: Piece(_SENTINEL, sum(len(x) for x in list(SENTINELS.values())[:i]), len(mark))
              for i, (name, mark) in enumerate(SENTINELS.items())}

    def __init__(self, text: memoryview, pieces: Sequence[Piece] | None = None) -> None:
        self.text = text
        self.pieces = [Piece(_TEXT, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, offset: int) -> None:
        """Split the piece that covers ``offset``, so that a piece begins there."""
        at = 0
        for k, p in enumerate(self.pieces):
            if at < offset < at + p.length:
                self.pieces[k:k + 1] = [Piece(p.buffer, p.start, offset - at), Piece(p.buffer, p.start + offset - at, at + p.length - offset)]
                return
            at += p.length

    def between(self, start: int, end: int) -> list[Piece]:
        """The pieces from ``start`` to ``end``, at which the table has been cut."""
        out, at = [], 0
        for p in self.pieces:
            if start <= at and at + p.length <= end and p.length:
                out.append(p)
            at += p.length
        return out

    def parts(self, first: int, second: int) -> dict[str, list[Piece]]:
        """Prefix, middle and suffix after cutting at two offsets."""
        self.cut(first)
        self.cut(second)
        size = sum(p.length for p in self.pieces)
        return {"prefix": self.between(0, first), "middle": self.between(first, second), "suffix": self.between(second, size)}

    def arranged(self, parts: dict[str, list[Piece]], form: str) -> PieceTable:
        """The parts in the order of ``form``, each behind its sentinel."""
        return PieceTable(self.text, [p for name in ARRANGEMENTS[form] for p in (self.places[name], *parts[name])])

    def restored(self, form: str) -> PieceTable:
        """Of a table over an output: its parts, found between the sentinels, in the order of the text."""
        raw, order = bytes(self.text), ARRANGEMENTS[form]
        at, found, begin = 0, [], []
        for name in order:
            at = raw.index(SENTINELS[name], at)
            found.append(at)
            at += len(SENTINELS[name])
            begin.append(at)
        parts = {}
        for name, a, b in zip(order, begin, [*found[1:], len(raw)], strict=True):
            self.cut(a)
            self.cut(b)
            parts[name] = (a, b)
        return PieceTable(self.text, [p for name in PARTS for p in self.between(*parts[name])])

    def chunks(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield (self.text if p.buffer == _TEXT else self.sentinels)[p.start:p.start + p.length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for chunk in self.chunks():
            h.update(chunk)
        return h.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.chunks())


def decide(digest: str, n_units: int, plain: bool, rate: int, suffix_first_rate: int) -> tuple[int, int, str]:
    """(units before the middle, units before the suffix, form) from the first four numbers of a hex digest."""
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
    a, b = h1 % (n_units + 1), h2 % (n_units + 1)
    if plain or h3 % 100 >= rate:
        return min(a, b), max(a, b), "plain"
    return min(a, b), max(a, b), "spm" if h4 % 100 < suffix_first_rate else "psm"


_DOC = "doc_id bigint, n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"


def _points(raw: memoryview, a: int, b: int) -> int:
    """Code points of some UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8)[a:b] & 0xC0) != 0x80))


def _rewrite(seed: int, rate: int, suffix_first_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = byte_map(SPACES, lower=False)
        for block in blocks(batches):
            raw, off = buffers(block.column("text"))
            _, ends = word_spans(lut[raw], SPACES[0])
            first = np.searchsorted(ends, off, "right")
            view, out = memoryview(raw.tobytes()), []
            for k, doc_id in enumerate(block.column("doc_id").to_pylist()):
                start, stop = int(off[k]), int(off[k + 1]) - 1  # without the closing newline
                text = view[start:stop]
                bounds = ends[first[k]:first[k + 1]] - start  # a unit ends where a word ends
                n = len(bounds) + int(len(text) > 0 and (not len(bounds) or bounds[-1] < len(text)))
                plain = not len(text) or any(mark in bytes(text) for mark in SENTINELS.values())
                digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                units, more, form = decide(digest, n, plain, rate, suffix_first_rate)
                table = PieceTable(text)
                row = [n, form, None, None]
                if form != "plain":
                    a, b = (0 if u == 0 else len(text) if u > len(bounds) else int(bounds[u - 1]) for u in (units, more))
                    row[2:] = _points(text, 0, a), _points(text, a, b)
                    table = table.arranged(table.parts(a, b), form)
                out.append((doc_id, *row, table.bytes().decode("utf-8", "replace"), table.sha256()))
            yield _batch(out, _DOC)
    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the text that output and form give back, and its digest."""
    for batch in batches:
        text, digest = [], []
        for output, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True):
            table = PieceTable(memoryview((output or "").encode("utf-8")))
            if form in ARRANGEMENTS:
                table = table.restored(form)
            text.append(table.bytes().decode("utf-8"))
            digest.append(table.sha256())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(digest, pa.string())],
                                         [*batch.schema.names, "restored", "restored_sha256"])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    cols = [c.split(" ") for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(cols)], [name for name, _ in cols])


def _inputs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))


def transform(documents: DataFrame, *, seed: int = SEED, rate: int = RATE, suffix_first_rate: int = SUFFIX_FIRST_RATE) -> DataFrame:
    """doc_id, n_units, form (plain, psm, spm), prefix_chars and middle_chars (null if plain), output and its SHA-256; a row per row."""
    return _inputs(documents).mapInArrow(_rewrite(seed, rate, suffix_first_rate), _DOC)


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` with restored and restored_sha256: the text that output and form alone give back."""
    kept = transformed.drop("restored", "restored_sha256")
    schema = StructType([*kept.schema.fields, StructField("restored", StringType()), StructField("restored_sha256", StringType())])
    return kept.mapInArrow(_restore, schema)


def round_trip(documents: DataFrame, *, seed: int = SEED, rate: int = RATE, suffix_first_rate: int = SUFFIX_FIRST_RATE) -> DataFrame:
    """``transform`` and ``restore`` batch by batch in one worker, without the texts."""
    made = _rewrite(seed, rate, suffix_first_rate)
    kept = [c.split(" ")[0] for c in _DOC.split(", ") if not c.startswith("output ")] + ["restored_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _restore(made(batches)):
            yield batch.select(kept)
    return _inputs(documents).mapInArrow(run, f"{_DOC.replace('output string, ', '')}, restored_sha256 string")
