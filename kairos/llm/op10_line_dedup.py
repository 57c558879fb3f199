"""Line dedup: an exact set-similarity join of lines, after which later matches go.

A line is the set of its lower-cased words; two lines match when the Jaccard
similarity of their sets is at least 0.8 (5 * overlap >= 4 * union, in whole
numbers). A line goes when a line that stands earlier, by (doc_id, line
number), matches it, whether that line stays or not.

1. **Rarity.** One narrow pass counts all words into a table of ``SLOTS``
   counters (a fixed size at any scale). The order of words is (count of the
   word's counter, hash): one total order for all lines, rare words first,
   which is all the prefix filter asks for.
2. **Distinct sets.** A second pass gives every line the 128-bit hash of its
   set, its prefix (the rarest words, one of which any match shares) and a
   bitmap of its words. Equal sets meet in one aggregation; their first
   line stands for them.
3. **Candidates.** Sets meet on each prefix word. Length filter, positional
   filter and the bitmap's bound on the overlap leave the sets that have a
   partner which may match; only these go on, not the pairs.
4. **Verify.** The words of those sets are fetched from their first lines and
   meet again by prefix word in the order of their first lines; each set looks
   for the first earlier one whose overlap suffices, and stops there. So a
   clump of near copies costs about its size, not the square of it. Meetings of more than ``CROWD`` sets
   are split: first against the earliest ``CROWD``, then whoever found none
   against all, in blocks.

Defined cases: every line with a word is compared, also the shortest; null and
empty texts and lines without a word have none to compare; all lines of rows
with a null doc_id stay; rows that repeat a doc_id are one document; of equal
sets the first line is the earlier one; an empty table gives an empty result;
``dedup_lines`` gives back the columns as they are, whatever their names.
Words and sets are compared by 64-bit hashes (XXH64 for long words; 128 bits a set).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import SPACES, WordHasher, blocks, buffers, byte_map, grows, mix, shared, text_bytes, unused, word_spans

#: Least distinct words of a line that is compared: any line with a word is.
MIN_WORDS = 1
#: Smaller sets match only equal ones (3 of 4 words is below 0.8), which meet by their hashes and need no prefix.
MIN_PREFIX_WORDS = 4
#: Counters of word frequency: 16 MB wherever they are held.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Text of a block: its word and line arrays take about 40 times as much.
BLOCK_BYTES = 2 << 20
#: Counters per row while task counts are added up.
CHUNK = 1 << 16
#: Sets that meet on one prefix word before their meeting is split.
CROWD = 4096


def needed_overlap(a, b):
    """Least overlap of sets of sizes a and b with Jaccard >= 0.8: 5 o >= 4 (a + b - o)."""
    return -(-4 * (a + b) // 9)


def prefix_size(n):
    """Words of a set of n, rarest first, one of which every match shares."""
    return n - (4 * n + 4) // 5 + 1


class Lines:
    """Lines of a block of texts: word hashes, and which line and text each word belongs to."""

    def __init__(self) -> None:
        self.hasher, self.lut = WordHasher(), byte_map(SPACES)

    def __call__(self, raw: np.ndarray, off: np.ndarray):
        """(word hashes, line of each word, text of each line, number of each line in its text)."""
        mapped = self.lut[raw]
        s, e = word_spans(mapped, SPACES[0])
        stop = np.flatnonzero(raw == 10)
        line = np.searchsorted(stop, s)
        doc = np.searchsorted(off, stop, "right") - 1
        number = np.arange(len(stop)) - np.searchsorted(stop, off[:-1])[doc] if len(stop) else stop
        return self.hasher(mapped, s, e), line, doc, number


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines, total = Lines(), np.zeros(SLOTS, np.uint32)  # a task reads far less than 2^32 words
    for block in blocks(batches, max_bytes=BLOCK_BYTES):
        words = lines(*buffers(block.column("text")))[0]
        np.add.at(total, _slot(words), 1)
    yield from _chunks({k: total[k * CHUNK:(k + 1) * CHUNK] for k in range(SLOTS // CHUNK)})


def _chunks(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, row in totals.items():
        if row.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array(
                [pa.compress(row.astype("<i8").tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["chunk", "counts"])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * CHUNK, codec="zstd", asbytes=True), "<i8")


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            row = _unpacked(packed)
            totals[k] = totals[k] + row if k in totals else row
    yield from _chunks(totals)


def added_counts(rows: DataFrame, count) -> np.ndarray:
    """Sums of the counter tables that ``count`` makes of the rows of each task."""
    counted = rows.mapInArrow(count, "chunk int, counts binary")
    counted = counted.repartition(F.col("chunk")).mapInArrow(_add_chunks, "chunk int, counts binary")
    out = np.zeros(SLOTS, np.uint32)
    for row in counted.collect():  # SLOTS / CHUNK rows
        out[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.minimum(_unpacked(bytes(row["counts"])), 0xFFFFFFFF)
    return out


def _sets(words: np.ndarray, line: np.ndarray, counts: np.ndarray | None = None):
    """Sets of words by line: (word number, line) sorted by line and then rarity; distinct words and their counts by number.

    Without ``counts`` the words of a line come in any one order.
    """
    import pandas as pd

    number, distinct = pd.factorize(words)
    often = None
    if counts is not None:
        often = counts[_slot(distinct)]
        by = np.lexsort((distinct, often))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        number, distinct, often = place[number], distinct[by], often[by]
    bits = max(int(len(distinct) - 1).bit_length(), 1)
    key = (line.astype(np.int64) << bits) | number
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & ((1 << bits) - 1), key >> bits, distinct, often


_LINE = "doc_id bigint, line int, h1 bigint, h2 bigint, copies int, n int, b1 bigint, b2 bigint, prefix array<bigint>"


def _describe(counts):
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int32()),
                        ("n", pa.int32()), ("b1", pa.int64()), ("b2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, lines = counts.value, Lines()
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            words, line, doc, number = lines(*buffers(block.column("text")))
            if not len(words):
                continue
            token, owner, distinct, freq = _sets(words, line, often)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((first, [len(owner)])))
            own = owner[first]
            h1, h2 = _set_hashes(distinct, token, first)
            bit = distinct & np.uint64(127)
            flag = np.uint64(1) << (bit & np.uint64(63))
            b1 = np.bitwise_or.reduceat(np.where(bit < 64, flag, np.uint64(0))[token], first)
            b2 = np.bitwise_or.reduceat(np.where(bit >= 64, flag, np.uint64(0))[token], first)
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)[doc[own]]
            keep = np.flatnonzero(size >= MIN_WORDS)
            # the first line of each set in the block stands for the set's lines there and has the prefix;
            # a word seen once in all texts has no partner
            by = np.lexsort((number[own][keep], ids[keep], h2[keep], h1[keep]))
            a, b = h1[keep][by], h2[keep][by]
            starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(by) else by
            copies = np.zeros(len(own), np.int32)
            copies[keep[by[starts]]] = np.diff(np.concatenate((starts, [len(by)])))
            pos = np.arange(len(owner)) - np.repeat(first, size)
            row = np.repeat(np.arange(len(own)), size)
            meets = (copies > 0) & (size >= MIN_PREFIX_WORDS)  # the others' bitmaps are never read
            b1, b2 = np.where(meets, b1, np.uint64(0)), np.where(meets, b2, np.uint64(0))
            used = meets[row] & (pos < prefix_size(size)[row]) & (freq[token] > 1)
            per = np.bincount(row[used], minlength=len(own))[keep]
            ends = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
            short = (distinct[token[used]] >> np.uint64(16)).astype(np.uint32).view(np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep], pa.int64()), pa.array(number[own][keep].astype(np.int32)), pa.array(h1[keep].view(np.int64)),
                 pa.array(h2[keep].view(np.int64)), pa.array(copies[keep]), pa.array(size[keep].astype(np.int32)),
                 pa.array(b1[keep].view(np.int64)), pa.array(b2[keep].view(np.int64)),
                 pa.ListArray.from_arrays(ends, pa.array((short << 32) | pos[used]))], schema=schema)
    return run


def _set_hashes(distinct: np.ndarray, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order of its words."""
    with np.errstate(over="ignore"):
        return (np.add.reduceat(mix(distinct + np.uint64(0x1234567))[token], first),
                np.add.reduceat(mix(distinct ^ np.uint64(0xA5A5A5A5DEADBEEF))[token], first))


_SET = "h1 bigint, h2 bigint, doc_id bigint, line int, copies bigint, n int, b1 bigint, b2 bigint, prefix array<bigint>"


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by h1 and stand for lines of one set in one block; gives the first line of each set and its number of lines."""
    names = [c.split(" ")[0] for c in _SET.split(", ")]
    held: pa.Table | None = None

    def merged(table: pa.Table) -> pa.Table:
        h1, h2, doc, line, copies = (table.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "line", "copies"))
        by = np.lexsort((line, doc, h2, h1))
        a, b = h1[by], h2[by]
        start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        out = table.take(pa.array(by[start]))
        total = np.add.reduceat(copies[by].astype(np.int64), start)
        return out.set_column(names.index("copies"), "copies", pa.array(total))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(names)])
        table = table.set_column(names.index("copies"), "copies", table.column("copies").cast(pa.int64()))
        table = merged(table if held is None else pa.concat_tables([held, table]))
        last = table.column("h1").to_numpy()
        cut = int(np.searchsorted(last, last[-1], "left"))  # the next batch may go on with this one
        yield from table.slice(0, cut).to_batches()
        held = table.slice(cut)
    if held is not None:
        yield from held.to_batches()


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key (token, n); gives (token, sid) of those with a partner that may match, and of crowded tokens all."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def settle(table: pa.Table) -> pa.RecordBatch:
        key, at, sid, b1, b2 = (table.column(c).to_numpy() for c in ("key", "at", "sid", "b1", "b2"))
        token, n = key >> 32, key & 0xFFFFFFFF
        b1, b2, at = b1.view(np.uint64), b2.view(np.uint64), at.astype(np.int64)
        last = np.searchsorted(token, token, "right")  # end of the row's meeting
        marked = (last - np.searchsorted(token, token, "left")) > CROWD
        i, lag = np.flatnonzero(~marked), 1
        while len(i):
            i = i[i + lag < last[i]]
            j = i + lag
            close = 5 * n[i] >= 4 * n[j]  # rows of a meeting come by n: later ones are no closer
            i, j = i[close], j[close]
            need = needed_overlap(n[i], n[j])
            fits = np.minimum(n[i] - at[i], n[j] - at[j]) >= need  # of the words from this one on
            a, b = i[fits], j[fits]
            differ = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64) + np.bitwise_count(b2[a] ^ b2[b])
            good = n[a] + n[b] - differ >= 2 * need[fits]
            marked[a[good]] = True
            marked[b[good]] = True
            lag += 1
        return pa.RecordBatch.from_arrays([pa.array(token[marked].astype(np.int32)), pa.array(sid[marked])], ["token", "sid"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 200_000:
            continue
        table = pa.Table.from_batches(held)
        token = table.column("key").to_numpy() >> 32
        cut = int(np.searchsorted(token, token[-1], "left"))
        if len(token) - cut > 4 * CROWD:
            # a crowded meeting needs no comparison here: all of its rows pass, and it is not held
            yield settle(table.slice(0, cut))
            some = table.slice(cut, len(token) - cut - CROWD - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), token[-1], np.int32)), some.column("sid").combine_chunks()], ["token", "sid"])
            cut = len(token) - CROWD - 1
        elif cut:
            yield settle(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        rows = len(token) - cut
    if held:
        yield settle(pa.Table.from_batches(held))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and places of the wanted lines: rows (doc_id, text, wanted: line, sid, h1, h2)."""
    lines = Lines()
    for block in blocks(batches, max_bytes=BLOCK_BYTES):
        words, line, doc, number = lines(*buffers(block.column("text")))
        wanted = block.column("wanted")
        row = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
        w = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(("line", "sid", "h1", "h2"), wanted.flatten().flatten(), strict=True)}
        # lines are numbered over the block; a text's first line is where its number is 0
        at = np.minimum(np.searchsorted(doc, row) + w["line"], len(doc))  # a repeated id may have a shorter text
        used = np.zeros(len(doc) + 1, bool)
        used[at] = True
        mine = used[line] if len(words) else np.zeros(0, bool)
        sid, packed, place = [], [], ([], [])
        if mine.any():
            token, owner, distinct, _ = _sets(words[mine], line[mine])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            h1, h2 = (h.view(np.int64) for h in _set_hashes(distinct, token, first))
            ends = np.concatenate((first[1:], [len(owner)]))
            found = np.searchsorted(owner[first], at)
            ok = found < len(first)
            ok[ok] &= (owner[first][found[ok]] == at[ok]) & (h1[found[ok]] == w["h1"][ok]) & (h2[found[ok]] == w["h2"][ok])
            flat = distinct[token]
            sid, packed = w["sid"][ok], [flat[first[k]:ends[k]].tobytes() for k in found[ok].tolist()]
            place = block.column("doc_id").to_numpy(zero_copy_only=False)[row[ok]], w["line"][ok]
        yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(place[0], pa.int64()), pa.array(place[1], pa.int32()),
                                          pa.array(packed, pa.binary())], ["sid", "doc_id", "line", "words"])


class _Meeting:
    """Sets of one meeting in the order of their first lines; finds the first earlier match of a set."""

    def __init__(self) -> None:
        self.places: list[tuple[int, int]] = []
        self.sets: list[frozenset] = []

    def add(self, place: tuple[int, int], words: frozenset) -> None:
        self.places.append(place)
        self.sets.append(words)

    def first_match(self, place: tuple[int, int], words: frozenset) -> tuple[int, int] | None:
        n = len(words)
        for other, have in zip(self.places, self.sets, strict=True):
            if other >= place:
                return None
            m = len(have)
            if 5 * min(n, m) >= 4 * max(n, m) and len(words & have) >= needed_overlap(n, m):
                return other
        return None


_FOUND = "token int, sid bigint, doc_id bigint, line int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (token, part, targets first, place); gives each probe's first earlier match in its meeting."""
    now, meeting = None, _Meeting()
    for batch in batches:
        out: list[tuple] = []
        cols = [batch.column(c).to_pylist() for c in ("token", "part", "target", "probe", "doc_id", "line", "sid", "words")]
        for token, part, target, probe, doc, line, sid, words in zip(*cols, strict=True):
            if (token, part) != now:
                now, meeting = (token, part), _Meeting()
            own = frozenset(np.frombuffer(words, np.uint64).tolist())
            if probe:
                found = meeting.first_match((doc, line), own)
                if found:
                    out.append((token, sid, *found))
            if target:
                meeting.add((doc, line), own)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(
            (pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["token", "sid", "doc_id", "line"])


def _meet(rows: DataFrame) -> DataFrame:
    """Verify rows (token, part, target, probe, doc_id, line, sid, words) meeting by meeting."""
    return (rows.select("token", "part", "target", "probe", "doc_id", "line", "sid", "words")
            .repartition("token", "part").sortWithinPartitions("token", "part", F.col("target").desc(), "doc_id", "line")
            .mapInArrow(_verify, _FOUND))


def first_matches(sets: DataFrame, docs: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """sid, match_doc, match_line: the first line of an earlier set that matches, for the sets that have one."""
    # one long to meet and sort by: token above, n below; at is the word's place in the set
    met = sets.select("sid", "n", "b1", "b2", F.explode("prefix").alias("p"))
    low = F.lit(0xFFFFFFFF).cast("long")
    met = (met.select(F.col("p").bitwiseAND(F.lit(-(1 << 32)).cast("long")).bitwiseOR(F.col("n").cast("long")).alias("key"),
                      F.col("p").bitwiseAND(low).cast("int").alias("at"), "sid", "b1", "b2")
           .repartition(F.shiftright("key", 32)).sortWithinPartitions("key"))
    near = shared(met.mapInArrow(_with_partner, "token int, sid bigint"), "line-candidates")
    chosen = sets.select("sid", "doc_id", "line", "h1", "h2").join(grows(near.select("sid").distinct()), "sid")
    wanted = shared(chosen.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("line", "sid", "h1", "h2")).alias("wanted")), "line-wanted")
    words = docs.join(grows(wanted), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "wanted").mapInArrow(
        _fetch, "sid bigint, doc_id bigint, line int, words binary")
    words = shared(words.dropDuplicates(["sid"]), "line-words")  # rows that repeat a document
    sizes = shared(near.groupBy("token").count().filter(F.col("count") > crowd), "line-crowds")
    yes, no = F.lit(True), F.lit(False)
    rows = near.join(grows(words), "sid")
    calm = rows.join(sizes, "token", "left_anti").select("*", F.lit(0).alias("part"), yes.alias("target"), yes.alias("probe"))
    found = _meet(calm)
    if sizes.limit(1).count():
        found = found.unionByName(_crowded(shared(rows.join(sizes, "token"), "line-crowded"), crowd))
    return (found.groupBy("sid").agg(F.min(F.struct("doc_id", "line")).alias("m"))
            .select("sid", F.col("m.doc_id").alias("match_doc"), F.col("m.line").alias("match_line")))


def _crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """Meetings of many sets: against about the ``crowd`` earliest first, then whoever found none against all, in blocks."""
    yes, no = F.lit(True), F.lit(False)
    parts = F.ceil(F.col("count") / crowd).cast("int")
    # the crowd-th smallest document of each meeting, nearly: all rows up to it lead
    halves = [0.5 ** k for k in range(1, 15)]
    level = F.least(F.lit(len(halves)), F.greatest(F.lit(1), F.ceil(F.log2(F.max("count") / crowd)))).cast("int")
    cut = shared(rows.groupBy("token").agg(F.element_at(F.percentile_approx("doc_id", halves, 100_000), level).alias("cut")), "line-cuts")
    rows = rows.join(cut, "token").withColumn("leads", F.col("doc_id") <= F.col("cut"))
    spread = rows.withColumn("part", F.pmod(F.xxhash64("sid"), parts).cast("int"))
    leaders = (rows.filter("leads").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
               .select("*", yes.alias("target"), no.alias("probe")))
    # leaders are probes too, once: in the part that is their own
    first = shared(_meet(leaders.unionByName(spread.select("*", no.alias("target"), yes.alias("probe")))), "line-led")
    rest = rows.join(first.select("token", "sid"), ["token", "sid"], "left_anti").filter(~F.col("leads"))
    probes = (rest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("*", no.alias("target"), yes.alias("probe")))
    return first.unionByName(_meet(spread.select("*", yes.alias("target"), no.alias("probe")).unionByName(probes)))


def removed_lines(documents: DataFrame, *, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(removed: doc_id, line, match_doc, match_line; compared: doc_id, line of every line that was compared).

    Line numbers start at 0; (match_doc, match_line) is the earliest line that matches.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text")).filter("doc_id is not null")
    counts = documents.sparkSession.sparkContext.broadcast(added_counts(docs.select("text"), _count_words))
    lines = shared(docs.mapInArrow(_describe(counts), _LINE), "lines")
    sets = (lines.filter("copies > 0").select(*[c.split(" ")[0] for c in _SET.split(", ")])
            .repartition("h1").sortWithinPartitions("h1").mapInArrow(_first_lines, _SET))
    sets = shared(sets.select(F.monotonically_increasing_id().alias("sid"), "*"), "line-sets")
    matched = shared(first_matches(sets, docs, crowd=crowd), "line-matches")
    # only sets with several lines or an earlier match have lines that go
    busy = shared(sets.select("sid", "h1", "h2", "copies", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"))
                  .join(grows(matched), "sid", "left").filter("copies > 1 or match_doc is not null"), "line-busy")
    own = F.struct("first_doc", "first_line")
    gone = (lines.select("doc_id", "line", "h1", "h2").join(grows(busy), ["h1", "h2"])
            .withColumn("m", F.when(F.col("match_doc").isNotNull(), F.least(own, F.struct(
                F.col("match_doc").alias("first_doc"), F.col("match_line").alias("first_line")))).otherwise(own))
            .filter(F.struct(F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line")) > F.col("m"))
            .select("doc_id", "line", F.col("m.first_doc").alias("match_doc"), F.col("m.first_line").alias("match_line")))
    return gone.distinct(), lines.select("doc_id", "line")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` without the removed lines; a document that keeps no word of those it had goes as a whole."""
    gone, _ = removed_lines(documents)
    id_, out_ = unused(documents, "doc"), unused(documents, "gone")
    by_doc = shared(gone.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line").alias(out_)), "lines-gone")

    @F.pandas_udf("string")
    def without(texts, gone):
        import pandas as pd

        def kept(text, out):
            if out is None or text is None:
                return text
            out = set(out)
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
        return pd.Series([kept(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)

    cut = documents.join(grows(by_doc), F.col("doc_id").cast("long") == F.col(id_), "left").withColumn("text", without("text", out_))
    emptied = F.col(out_).isNotNull() & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    return cut.filter(~F.coalesce(emptied, F.lit(False))).select(*[F.col(f"`{c}`") for c in documents.columns])
