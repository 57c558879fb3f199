"""WARC archives with a two-level capture index.

Writing: one record per page (response, or revisit of the response that has
the same payload), each a gzip member of its own, so that a record can be
read by its range. Every task writes files of its own name; only files that
a finished task reports are ever read.

Index: captures sorted by reversed-host URL key and page id (range
partitions, so one host may hold any share) go into compressed blocks of
``BLOCK_LINES`` lines; per index shard a sparse directory holds the first
capture of each block and the block's range; the first capture of each shard
is all that the driver sees (one row per index partition).

Lookup: binary search over shards, over the shard's directory, read that
block's range, binary search in it, read the record's range. Lookups come
sorted, so a task reads each block once and holds a few of them.

Archives and index lie under the shared checkpoint folder (any file system
that pyarrow opens by URI).

Defined cases: null html is an empty payload; null urls have the key ``)``;
null page ids sort first and are never referred to; rows that repeat the
largest page id of a payload are all responses; an empty table gives an empty
archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import shared
from kairos.sources.writers import shared_path

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Captures in a block of the index.
BLOCK_LINES = 500
#: Decompressed blocks that a lookup task holds.
HELD_BLOCKS = 4
#: Bytes of records that a lookup task sends on together.
SEND_BYTES = 8 << 20
#: The tables carry no fetch times; every record has this one.
DATE = "1970-01-01T00:00:00Z"
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; printable ASCII without spaces."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + quote(text, safe=_SAFE)
    labels = host.split(".")
    if len(labels) > 2 and labels[0].startswith("www") and (labels[0][3:] or "0").isdigit():
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "")
    return quote(f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe=_SAFE)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which has the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)),
              ("WARC-Target-URI", quote(url or "", safe=_SAFE)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = head if refers_to is not None else head + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record: page_id, url, record_type, refers_to, payload (None for revisits), payload_bytes, payload_digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ", 1)[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    number = lambda s: int(s) if (s := s[len("<urn:page:"):-1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
           "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
           "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != out["payload_digest"]):
        raise ValueError(f"record of page {out['page_id']} does not hold its payload")
    return out


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


# --- archives ------------------------------------------------------------------------------------------------------


def _write_records(root: str):
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id, url, payload, digest, refers_to)) + squeeze.flush()
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
        if out is not None:
            out.close()
    return run


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id and refers_to of the pages whose payload another page with a larger id has too."""
    slim = shared(pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")), "warc-digests")
    slim = slim.filter((F.col("size") >= least) & F.col("page_id").isNotNull())
    keepers = shared(slim.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                     .filter("n > 1").select("digest", "size", "refers_to"), "warc-keepers")
    return (slim.join(keepers, ["digest", "size"]).filter("page_id != refers_to")
            .select("page_id", F.col("digest").alias("of"), "refers_to").distinct())


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record under ``root``; key, page_id, file, start and size of each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    back = shared(revisits(rows), "warc-revisits").withColumnRenamed("page_id", "_id")
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(back, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("of")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return shared(rows.mapInArrow(_write_records(root), "key string, page_id bigint, file string, start bigint, size bigint"), "warc-captures")


# --- index ---------------------------------------------------------------------------------------------------------


def _rank(page_id: int | None) -> tuple[int, int]:
    return (0, 0) if page_id is None else (1, page_id)


def _write_blocks(root: str, lines_per_block: int):
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("shard", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        shard, out, at, n = uuid.uuid4().hex, None, 0, 0
        directory, lines, first, lead = [], [], None, None

        def close_block():
            nonlocal at, lines
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            directory.append(f"{first[0]} {'-' if first[1] is None else first[1]} {at} {len(packed)}")
            at, lines = at + len(packed), []

        for batch in batches:
            for key, page_id, file, start, size in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "page_id", "file", "start", "size")), strict=True):
                if out is None:
                    out, lead = system.open_output_stream(f"{base}/{shard}.blocks", compression=None), (key, page_id)
                if not lines:
                    first = (key, page_id)
                lines.append(f"{key} {'-' if page_id is None else page_id} {file} {start} {size}")
                n += 1
                if len(lines) == lines_per_block:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            with system.open_output_stream(f"{base}/{shard}.directory", compression=None) as f:
                f.write(zlib.compress("\n".join(directory).encode(), 6))
            yield pa.RecordBatch.from_pylist([{"key": lead[0], "page_id": lead[1], "shard": shard, "n": n}], schema=schema)
    return run


class Index:
    """Where an index lies: its folder, the archives' folder, and the first capture of each shard in order."""

    def __init__(self, root: str, archives: str, shards: list[tuple[str, int | None, str]]) -> None:
        self.root, self.archives = root, archives
        self.shards = sorted(shards, key=lambda s: (s[0], _rank(s[1])))


def build_index(captures: DataFrame, root: str, archives: str, lines_per_block: int = BLOCK_LINES) -> Index:
    """Sort the captures into blocks; one shard for each range partition."""
    spark = captures.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    shards = shared(ranged.mapInArrow(_write_blocks(root, lines_per_block), "key string, page_id bigint, shard string, n bigint"), "warc-shards")
    return Index(root, archives, [(r["key"], r["page_id"], r["shard"]) for r in shards.collect()])


class _Reader:
    """Range reads through the two levels, with a few blocks and files held."""

    def __init__(self, root: str, archives: str, shards: list[tuple[str, int | None, str]]) -> None:
        self.system, self.base = _open(root)
        self.archive_system, self.archives = _open(archives)
        self.shards = [s[2] for s in shards]
        self.leads = [(s[0], _rank(s[1])) for s in shards]
        self.directories, self.blocks, self.files = {}, {}, {}

    @staticmethod
    def _held(cache: dict, key, make, most: int):
        if key not in cache:
            if len(cache) >= most:
                cache.pop(next(iter(cache)))
            cache[key] = make()
        return cache[key]

    def directory(self, shard: str):
        def read():
            with self.system.open_input_file(f"{self.base}/{shard}.directory") as f:
                rows = [x.split(" ") for x in zlib.decompress(f.read()).decode().split("\n")]
            return ([(k, _rank(None if i == "-" else int(i))) for k, i, _, _ in rows], [(int(a), int(n)) for _, _, a, n in rows])
        return self._held(self.directories, shard, read, 2)

    def block(self, shard: str, number: int):
        def read():
            start, size = self.directory(shard)[1][number]
            with self.system.open_input_file(f"{self.base}/{shard}.blocks") as f:
                rows = [x.split(" ") for x in zlib.decompress(f.read_at(size, start)).decode().split("\n")]
            return ([(k, _rank(None if i == "-" else int(i))) for k, i, *_ in rows], [(f, int(a), int(n)) for _, _, f, a, n in rows])
        return self._held(self.blocks, (shard, number), read, HELD_BLOCKS)

    def captures(self, low: tuple, high: tuple) -> Iterator[tuple[str, int, int]]:
        """Ranges of the records from ``low`` to ``high``, both included, in order."""
        s = max(bisect_left(self.leads, low) - 1, 0)
        while s < len(self.shards) and self.leads[s] <= high:
            firsts = self.directory(self.shards[s])[0]
            for b in range(max(bisect_left(firsts, low) - 1, 0), bisect_right(firsts, high)):
                keys, places = self.block(self.shards[s], b)
                yield from places[bisect_left(keys, low):bisect_right(keys, high)]
            s += 1

    def record(self, file: str, start: int, size: int) -> dict:
        f = self._held(self.files, file, lambda: self.archive_system.open_input_file(f"{self.archives}/{file}"), 16)
        return parse(zlib.decompress(f.read_at(size, start), 31))


_RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, "
           "payload_digest string")


def _read_records(held, payloads: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(*held.value)
        for batch in batches:
            out, size = [], 0
            for key, page_id, every in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "every")), strict=True):
                low, high = ((key, (0, 0)), (key, (2, 0))) if every else ((key, _rank(page_id)),) * 2
                for place in reader.captures(low, high):
                    row = reader.record(*place)
                    if not payloads:
                        row["payload"] = None
                    size += len(row["payload"] or b"") + 200
                    out.append(row)
                    if size > SEND_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def lookup(wanted: DataFrame, index: Index, *, payloads: bool = True) -> DataFrame:
    """Records of the captures asked for.

    ``wanted`` has a url; with a column page_id, that capture of the url is
    read (null: the one without an id), without it every capture.
    """
    spark = wanted.sparkSession
    every = "page_id" not in wanted.columns
    page_id = F.lit(None).cast("long") if every else F.col("page_id").cast("long")
    keys = wanted.select(_key_udf()(F.col("url")).alias("key"), page_id.alias("page_id"), F.lit(every).alias("every")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.mapInArrow(_read_records(spark.sparkContext.broadcast((index.root, index.archives, index.shards)), payloads), _RECORD)


def _key_udf():
    @F.pandas_udf("string")
    def key(urls):
        import pandas as pd
        return pd.Series([url_key(u) for u in urls], dtype=object)
    return key


def archive(pages: DataFrame, name: str = "warc") -> Index:
    """Write the archives and their index into a fresh shared folder."""
    spark = pages.sparkSession
    root = shared_path(spark, f"llm-{name}")
    root = root if "://" in root or root.startswith("file:") else "file://" + root
    for part in ("archives", "index"):
        system, base = _open(f"{root}/{part}")
        system.create_dir(base, recursive=True)
    captures = write_archives(pages, f"{root}/archives")
    return build_index(captures, f"{root}/index", f"{root}/archives")
