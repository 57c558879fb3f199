"""SimHash near-duplicate groups by the generalised pigeonhole principle.

1. **Fingerprints** (Arrow batches): lower-case A-Z, words, 3-word shingles,
   XXH64 of each, and per bit the majority over the shingles.
2. **Distinct fingerprints** with their smallest doc_id; copies of a text
   meet here in a partial aggregation and go no further.
3. **Bit partitions.** Correlated bits go into one partition (64 x 64
   co-occurrence counts over all distinct fingerprints).
4. **Thresholds.** With m partitions and thresholds t_1..t_m whose sum is
   ``max_bits - m + 1``, two fingerprints within ``max_bits`` agree to t_i or
   fewer bits in some partition i (t_i = -1: the partition is not probed).
   Dynamic programming picks the t_i, and the number of partitions, with the
   fewest estimated candidates (bucket histograms of all fingerprints).
5. **Probe and verify.** Join each partition's values with the values within
   t_i of them, then keep pairs by the bit count of their XOR.
6. **Crowded buckets** (over ``CROWD`` members) would give the square of
   their size. Their members are linked exactly another way: two words are
   within b bits of each other iff some word lies within b/2 bits (rounded up)
   of one and b/2 (rounded down) of the other, so every member goes to the
   words that near, and whoever meets at a word is linked to the smallest
   of those within the lesser distance. With 2 bits these are 65 rows a
   member, at most 65 members a meeting.
7. **Components** of the links by alternating large-star and small-star
   rounds, every round a written table.

Defined cases: null, empty and wordless texts have fingerprint zero and link
like any other; rows with a null doc_id get a fingerprint and a component but
never name one (component_id is null when no member has an id); rows that
repeat a doc_id are rows of one document; ``deduplicate`` gives back the
columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import shared, unused

SHINGLE_WORDS = 3
MAX_BITS = 2
BITS = 64
SEED = 42
#: Members a probed bucket may have before it is linked through one-bit neighbours instead of pairs.
CROWD = 64


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text; bytes.lower and bytes.split know ASCII only, as the word class does."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(len(words) - shingle_words + 1, 1)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))[:n].tolist()
    stop = end[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(start, stop, strict=True)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprint_batches(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint_of(t.as_py() or b"", shingle_words) for t in batch.column("text")],
                              np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])
    return run


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), one row per input row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .mapInArrow(_fingerprint_batches(shingle_words), "doc_id bigint, fp bigint"))


# --- partitions and thresholds -------------------------------------------------------------------------------------


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(prints), 1 << 16):
            bits = np.unpackbits(prints[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            both += np.rint(bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
            n += len(bits)
    i, j = np.meshgrid(np.arange(BITS), np.arange(BITS), indexing="ij")
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
                                      pa.array(both.ravel()), pa.array(np.full(BITS * BITS, n))], ["i", "j", "both", "n"])


def bit_correlation(prints: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the bits (a fixed-size aggregate)."""
    rows = (prints.select("fp").mapInArrow(_bit_counts, "i int, j int, both bigint, n bigint")
            .groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect())
    both, n = np.zeros((BITS, BITS)), 1.0
    for r in rows:
        both[r["i"], r["j"]], n = r["both"], max(r["n"], 1)
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))


def partition_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64/m bits each; a group grows by the bit most correlated with its members."""
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = correlation[np.ix_(left, left)].sum(0)
        group = [left.pop(int(np.argmax(rest)))]
        while len(group) < size:
            best = int(np.argmax(correlation[np.ix_(group, left)].sum(0)))
            group.append(left.pop(best))
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` and least sum of ``costs[i][t_i + 1]``, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if cost + c < step.get(used + t, (np.inf,))[0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[total]


def _value(fp: str, bits: list[int]):
    """The bits of a partition, packed into a long."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(fp), b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def _masks(width: int, radius: int) -> list[int]:
    """XOR masks of at most ``radius`` bits over ``width`` bits."""
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(width), r)]


def choose_plan(prints: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, with the fewest estimated candidates.

    For m partitions of width w, candidates at radius r are estimated from the
    bucket histogram: sum of squared bucket sizes, times the number of masks
    within r for neighbouring buckets at the mean size, plus the probes
    themselves.
    """
    correlation = bit_correlation(prints)
    plans = []
    sets = {m: partition_bits(correlation, m) for m in range(2, max_bits + 3)}
    squares: dict[tuple[int, int], float] = {}
    n = 0.0
    for m, groups in sets.items():
        made = prints.select(F.posexplode(F.array(*[_value("fp", bits) for bits in groups])).alias("part", "value"))
        sizes = made.groupBy("part", "value").count()
        crowd = F.least(F.col("count"), F.lit(CROWD)).cast("double")
        for r in sizes.groupBy("part").agg(F.sum(F.col("count") * crowd).alias("sq"), F.sum("count").alias("n")).collect():
            squares[m, r["part"]] = float(r["sq"])
            n = float(r["n"])
    for m, groups in sets.items():
        costs = []
        for i, bits in enumerate(groups):
            row = [0.0]
            for radius in range(max_bits + 1):
                masks = len(_masks(len(bits), radius))
                row.append(squares.get((m, i), 0.0) + (masks - 1) * n * n / 2.0 ** len(bits) + masks * (n + 1))
            costs.append(row)
        cost, chosen = allocate(costs, max_bits - m + 1)
        plans.append((cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


# --- links ------------------------------------------------------------------------------------------------------


def links(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of distinct ``fp`` within ``max_bits``.

    Every pair from a bucket of at most ``crowd`` members is given itself; in
    larger buckets, the links through a common neighbour (step 6).
    """
    plan = choose_plan(prints, max_bits)
    index = shared(prints.select("fp", F.posexplode(F.array(*[_value("fp", bits) for bits, _ in plan])).alias("part", "value")),
                   "simhash-index")
    probes = index
    if any(t > 0 for _, t in plan):
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in _masks(len(bits), t)]) for bits, t in plan])
        probes = index.select("fp", "part", F.explode(F.transform(masks[F.col("part")], lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    full = shared(sizes.filter(F.col("n") > crowd).select("part", "value"), "simhash-crowded")
    key = ["part", "value"]
    pairs = (index.join(full, key, "left_anti").withColumnRenamed("fp", "a")
             .join(probes.withColumnRenamed("fp", "b"), key)
             .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    members = probes.join(full, key, "left_semi").select("fp").distinct()
    low, high = max_bits // 2, max_bits - max_bits // 2
    around = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in _masks(BITS, high)])
    spread = members.select("fp", F.explode(F.transform(around, lambda m: m.bitwiseXOR(F.col("fp")))).alias("at"))
    # whoever meets at a word links to the smallest that is within ``low`` bits of it
    near = F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("at"))) <= low, F.col("fp")) if low < high else F.col("fp")
    met = spread.groupBy("at").agg(F.collect_set("fp").alias("met"), F.min(near).alias("hub"))
    met = (met.filter(F.size("met") > 1).filter("hub is not null").select("hub", F.explode("met").alias("b")).filter(F.col("hub") != F.col("b"))
           .select(F.least("hub", "b").alias("a"), F.greatest("hub", "b").alias("b")))
    return pairs.union(met).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Alternating large-star and small-star; every step is a written table, so
    a lost executor costs a retry of one step.
    """
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "star")
        edges = shared(both.join(least, "a").filter("b > a").select(F.col("low").alias("a"), "b").distinct(), "large")
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = shared(down.groupBy("u").agg(F.min("v").alias("low")), "star")
        moved = down.join(least, "u").select("v", "low").filter("v != low")
        edges = shared(moved.select(F.col("low").alias("a"), F.col("v").alias("b"))
                       .union(least.select(F.col("low").alias("a"), F.col("u").alias("b"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("b")).first()
        if now == state or now[0] == now[2] and not edges.join(
                edges.select(F.col("b").alias("_b")), F.col("a") == F.col("_b"), "left_semi").limit(1).count():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(documents: DataFrame, *, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that links reach) of every row of ``documents``."""
    prints = shared(fingerprints(documents, shingle_words), "simhash-prints")
    distinct = shared(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(shared(links(distinct.select("fp"), max_bits), "simhash-links"))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = shared(named, "simhash-named")
    lowest = shared(named.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")
    of_print = shared(named.join(lowest, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def deduplicate(documents: DataFrame, *, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: the rows whose doc_id names the group, and rows with a null doc_id.

    Rows that repeat a doc_id are one document and stay or go together.
    """
    groups = near_duplicates(documents, shingle_words=shingle_words, max_bits=max_bits)
    id_ = unused(documents, "gone_id")
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_)).distinct()
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(id_), "left_anti")


def hex16(fp: str):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

