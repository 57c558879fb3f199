"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

Encoding:

1. **Explode.** Texts split into pre-tokens. A block (a few MB of whole
   documents of one task) keeps its distinct words, each once, and the
   positions: the word numbers of all its pre-tokens in order. So what is
   shuffled is a word per block, never a row per occurrence, and packed: one
   row per block and word bucket. The blocks are written once, bucketed by block.
2. **Encode.** The words of all blocks meet by bucket; a task encodes each
   distinct word of its buckets once, as the rows stream by, and answers every
   block's list of words with a list of ids.
3. **Join back and reassemble.** The answers join the blocks by their bucketing
   (the positions never move) and each document is put together by position.

Decoding joins the token-byte table (fixed size: the vocabulary) to the ids
with one vectorised lookup per batch.

Defined cases: null and empty texts have no tokens; special-token strings are
ordinary text; repeated rows give a row each; decoding an id outside the
vocabulary raises.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import blocks, bucketed, small_batches

#: Text of a block: larger blocks shuffle fewer words and hold more in a worker.
BLOCK_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder_of(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, built once a worker process (a worker runs many tasks)."""
    held = vars(tiktoken).setdefault("_kairos_encoders", {})  # this package's code is pickled by value, so its own globals live a task
    if (ranks_path, pattern) not in held:
        held.clear()
        held[ranks_path, pattern] = encoder(read_ranks(ranks_path), pattern)
    return held[ranks_path, pattern]


def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed byte planes of non-negative int32 numbers (the high bytes are nearly all zero)."""
    return _squeezed(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()) if len(numbers) else b""


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<i4").ravel()


_DECODED = "doc_id bigint, ids array<int>, bytes binary"
_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_BLOCK = ("block string, doc_ids array<bigint>, sizes array<int>, codes binary, numbers binary, "
          "words array<struct<bucket:int,n:int,size:int,lengths:binary,packed:binary>>")


def _split_blocks(pattern: str, buckets: int):
    """Blocks of documents: positions as numbers of words by frequency, the place of each of them in the word lists,
    and the word lists by bucket."""
    row = pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("lengths", pa.binary()), ("packed", pa.binary())])
    schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()),
                        ("numbers", pa.binary()), ("words", pa.list_(row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext
        part, split = TaskContext.get().partitionId(), regex.compile(pattern).findall
        for k, block in enumerate(blocks(batches, max_bytes=BLOCK_BYTES)):
            pieces, sizes = [], []
            for text in block.column("text").to_pylist():
                found = split(text)
                sizes.append(len(found))
                pieces.append(pa.array(found, pa.string()))
            coded = pa.chunked_array(pieces, pa.string()).combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            raw = coded.indices.to_numpy(zero_copy_only=False)
            words = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
            # codes: frequent words have small numbers, which compress well
            rank = np.empty(len(words), np.int64)
            rank[np.argsort(-np.bincount(raw, minlength=len(words)), kind="stable")] = np.arange(len(words))
            # lists: words by bucket, sorted; a word's place in them, by its rank
            at = [zlib.crc32(w) % buckets for w in words]
            listed = sorted(range(len(words)), key=lambda i: (at[i], words[i]))
            place = np.empty(len(words), np.int64)
            place[rank[listed]] = np.arange(len(words))
            lists, i, own, body = [], 0, [], b""
            while i < len(listed):
                j, bucket = i, at[listed[i]]
                while j < len(listed) and at[listed[j]] == bucket:
                    j += 1
                own = [words[x] for x in listed[i:j]]
                body = b"".join(own)
                lists.append({"bucket": bucket, "n": j - i, "size": len(body), "lengths": _packed(np.array([len(w) for w in own])),
                              "packed": _squeezed(body)})
                i = j
            sizes, codes, numbers = pa.array([sizes], pa.list_(pa.int32())), _packed(rank[raw]), _packed(place)
            del pieces, coded, raw, words, rank, at, listed, place, own, body  # before others compute
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{k}"]), pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())), sizes,
                 pa.array([codes], pa.binary()), pa.array([numbers], pa.binary()), pa.array([lists], pa.list_(row))], schema=schema)
    return run


def _encode_lists(ranks_path: str, pattern: str):
    """(block, bucket, ids): number of ids of each word of a list, then all ids; a word is encoded when it is first seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder_of(ranks_path, pattern)._core_bpe.encode_single_piece, {}
        for batch in batches:
            out, total = [], []
            for n, size, lengths, packed in zip(*(batch.column(c).to_pylist() for c in ("n", "size", "lengths", "packed")), strict=True):
                body = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
                ids, start = [], 0
                for end in np.cumsum(_unpacked(lengths, n), dtype=np.int64).tolist():
                    word = body[start:end]
                    if word not in seen:
                        seen[word] = encode(word)
                    ids.append(seen[word])
                    start = end
                flat = np.array([x for w in ids for x in w], np.int64)
                out.append(_packed(np.concatenate([np.array([len(w) for w in ids], np.int64), flat])))
                total.append(n + len(flat))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), batch.column("n"), pa.array(total, pa.int32()),
                                              pa.array(out, pa.binary())], ["block", "bucket", "n", "total", "ids"])
    return run


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: positions, places and the ids of its word lists; gives the ids of each document."""
    for batch in batches:
        for r in range(batch.num_rows):
            lists = sorted(batch.column("lists")[r].as_py() or [], key=lambda x: x["bucket"])
            parts = [(x["n"], _unpacked(x["ids"], x["total"])) for x in lists]
            lens = np.concatenate([np.zeros(0, np.int64), *[x[:n] for n, x in parts]])
            flat = np.concatenate([np.zeros(0, np.int32), *[x[n:] for n, x in parts]]).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
            place = _unpacked(batch.column("numbers")[r].as_py(), len(lens))
            table = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).take(pa.array(place))
            sizes = np.asarray(batch.column("sizes")[r].as_py(), np.int64)
            codes = _unpacked(batch.column("codes")[r].as_py(), int(sizes.sum()))
            ids = table.take(pa.array(codes))
            of_doc = ids.offsets.to_numpy()[np.concatenate(([0], np.cumsum(sizes)))] - ids.offsets[0].as_py() if len(ids) else np.zeros(len(sizes) + 1)
            docs = pa.array(batch.column("doc_ids")[r].as_py(), pa.int64())
            whole = pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), ids.flatten().cast(pa.int32()) if len(ids) else pa.array([], pa.int32()))
            del lists, parts, lens, flat, ends, place, table, sizes, codes, ids, of_doc  # before others compute
            yield pa.RecordBatch.from_arrays([docs, whole], ["doc_id", "ids"])


def _encoded_blocks(documents: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """A row per block, as ``_reassemble`` takes it."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"),
                            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = bucketed(docs.mapInArrow(_split_blocks(pattern, buckets), _BLOCK), "bpe_blocks", "block", buckets)
    lists = split.select("block", F.explode("words").alias("w")).select("block", "w.*")
    answers = lists.repartition(buckets, "bucket").mapInArrow(_encode_lists(ranks_path, pattern), "block string, bucket int, n int, total int, ids binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "total", "ids")).alias("lists"))  # one per bucket at most
    back = split.select("block", "doc_ids", "sizes", "codes", "numbers").join(answers, "block", "left")
    return back.select("doc_ids", "sizes", "codes", "numbers", "lists")


def encode(documents: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    return _encoded_blocks(documents, ranks_path, pattern, id_col, text_col).mapInArrow(_reassemble, "doc_id bigint, ids array<int>")


def encode_and_decode(documents: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``: doc_id, ids and bytes. Ids are decoded in the worker that reassembles them: a task has one worker, not two."""
    made = _decode_batches(ranks_path)
    return _encoded_blocks(documents, ranks_path, pattern, id_col, text_col).mapInArrow(
        lambda batches: made(_reassemble(batches)), _DECODED)


def encode_and_digest(documents: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests`` of ``encode``, in one worker a task."""
    made = _decode_batches(ranks_path)
    return _encoded_blocks(documents, ranks_path, pattern, id_col, text_col).mapInArrow(
        lambda batches: _digest_batches(made(_reassemble(batches))), _DIGESTS)


def _decode_batches(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            token[i] = raw
        token = pa.array(token, pa.binary())
        for batch in batches:
            ids = batch.column("ids")
            raw = token.take(ids.flatten())
            ends = np.frombuffer(raw.buffers()[1], np.int32, count=len(raw) + 1)
            at = ends[ids.offsets.to_numpy(zero_copy_only=False) - ids.offsets[0].as_py()]
            data = raw.buffers()[2] or pa.py_buffer(b"")
            text = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, text], ["doc_id", "ids", "bytes"])
    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and bytes: the concatenated bytes of the tokens."""
    return (encoded.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
            .mapInArrow(_decode_batches(ranks_path), _DECODED))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import pyarrow.compute as pc
    for batch in batches:
        ids = batch.column("ids")
        told = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string()))
        joined = pc.binary_join(told, " ").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
             pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("bytes")])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests (hex) of the decimal ids joined by spaces and of the decoded bytes.

    The digests are taken of ``decode``'s batches in the worker that makes them.
    """
    made = _decode_batches(ranks_path)
    return (encoded.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
            .mapInArrow(lambda batches: _digest_batches(made(batches)), _DIGESTS))
