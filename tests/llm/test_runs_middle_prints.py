"""Periodic runs, fill-in-the-middle and I-Match fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from kairos.llm import op11_periodic_runs, op12_fill_middle, op13_imatch, queries
from kairos.llm.neighbours import with_next

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 -----------------------------------------------------------------------------------------------------------


def brute_runs(words):
    """Every maximal stretch of each period, by definition."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                seg = words[i - q:j]
                if not any(all(x == y for x, y in zip(seg[p:], seg, strict=False)) for p in range(1, q)):
                    out.append((i - q, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(rng, n):
    for _ in range(n):
        letters = rng.choice(["a", "ab", "abc", ["x", "yy", "ü", "z" * 300, "#"]])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * rng.randint(2, 7))[:rng.randint(1, 70)]
        yield rng.choice([" ", "\n", " \t "]).join(words)


def test_runs(spark):
    rng = random.Random(11)
    rows = list(enumerate(random_texts(rng, 400)))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, " ".join(fib[-1])), (1004, "so " * 5000), (1005, "a b c " * 1500 + "d " + "a b c " * 4),
             (1006, "one two"), (1006, "one two"), (None, "x " * 6), (1007, "A a " * 10), (1008, " ".join(f"w{k % 997}" for k in range(4500)))]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, runs int, n_words string").repartition(3)
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in op11_periodic_runs.periodic_runs(df).collect())
    want = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        runs = [(0, 4500, 997)] if d == 1008 else brute_runs(w) if len(w) < 1000 else {
            1004: [(0, 5000, 1)], 1005: [(0, 4500, 3), (4501, 12, 3)]}[d]
        want[(d, len(w), tuple(runs), collapsed(w, runs))] += 1
    assert got == want
    assert op11_periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_thue_morse_words_are_different(spark):
    """Words whose polynomial hashes would agree modulo 2^64 make no run."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    text = " ".join([a, b, a, a, b, a, b, b] * 2)
    row = op11_periodic_runs.periodic_runs(spark.createDataFrame([(1, text), (2, " ".join([a] * 6))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert row[0].runs == [] and [tuple(x) for x in row[1].runs] == [(0, 6, 1)]


def test_runs_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(7001, None, None, None, None), (7002, "", "en", "s", 0), (7004, "solo", "en", "s", 4), (7006, "b a " * 40, "en", "s", 1),
           (7006, "b a " * 40, "en", "s", 1), (None, "c " * 9, "en", "s", 1), (7009, "x y " * 6 + "z " * 12 + "k", "en", "s", 3)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect())
    want = Counter()
    for d, t in rows:
        w = planted(d, WORD.findall(t or ""))
        runs, best = brute_runs(w), None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[(d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(told), sha(collapsed(w, runs)))] += 1
    assert got == want and sum(r[1] > 0 for r in want) > 10


# --- 12 -----------------------------------------------------------------------------------------------------------

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["", None, "  ", "\n", "a", "a ", "é ü\n", " x", "a<P>b", "<S", "x<M>", "a\x00b c", "ab\x1ccd\x85e f", "  lead and trail \t\n", "\U0001f600 <> <P x"]


def test_fill_in_middle(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000 + k, t) for k, t in enumerate(ODD * 6)] + [(None, "no id at all"), (6, "twice here"), (6, "twice here"), (9000, "long " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, output int").repartition(3)
    made = op12_fill_middle.transform(df)
    got = Counter((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored, r.restored_sha256)
                  for r in op12_fill_middle.restore(made).collect())
    want = Counter()
    for d, t in rows:
        b = brute_middle(d, t)
        want[(d, *b, sha(b[4]), t or "", sha(t or ""))] += 1
    assert got == want and {k[2] for k in want} == {"plain", "spm", "psm"}
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    query = Counter(tuple(r) for r in queries.QUERIES["op12_fill_in_middle"](spark, str(tmp_path)).collect())
    assert query == Counter({(k[0], *k[1:5], k[6], k[8]): n for k, n in want.items()})
    assert op12_fill_middle.transform(df.limit(0)).count() == 0


def test_piece_table_splits_and_never_copies():
    text = memoryview("alpha beta gamma".encode())
    table = op12_fill_middle.PieceTable(text)
    parts = table.parts(5, 10)
    assert [p.length for p in table.pieces] == [5, 5, 6] and all(p.buffer == 0 for p in table.pieces)
    out = table.arranged(parts, "spm")
    assert out.text is text and out.bytes() == b"<S> gamma<P>alpha<M> beta"
    assert out.sha256() == hashlib.sha256(out.bytes()).hexdigest()
    back = op12_fill_middle.PieceTable(memoryview(out.bytes())).restored("spm")
    assert back.bytes() == bytes(text)
    assert op12_fill_middle.PieceTable(memoryview(b"<P><S>ab<M>")).restored("psm").bytes() == b"ab"


# --- 13 -----------------------------------------------------------------------------------------------------------


def oracle(name, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    found = con.sql(queries.ORACLE[name])
    return found.columns, Counter(found.fetchall())


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_document_fingerprints"])
def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    rows += [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, None), (6, "twice"), (6, "twice"), (6, "another of six"), (-3, "minus three " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    cols, want = oracle(name, tmp_path)
    got = Counter(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == want


def test_fingerprints(spark):
    text = " ".join(f"word{k}" for k in range(300))
    near = text.replace("word17 ", "other ").replace("word250", "word999")
    rows = [(1, text), (2, text), (3, near), (4, " ".join(f"far{k}" for k in range(300))), (5, None), (6, ""), (7, " .. "), (8, " ".join(reversed(text.split())) + "!"),
            (9, "w " * 50_000)] + [(100 + k, f"common filler text number{k} of{k} many{k}") for k in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, terms int")
    got = {r.doc_id: r.fingerprint for r in op13_imatch.fingerprints(df).collect()}
    n = 1 + op13_imatch.REPLICAS * len(op13_imatch.LEVELS)
    assert got[8] == got[1]  # the same terms in another order
    assert all(len(x) == n * op13_imatch.DIGITS for x in got.values())
    assert got[1] == got[2] and got[5] == got[6] == got[7] == op13_imatch.EMPTY * n
    pairs = spark.createDataFrame([(a, b, got[a], got[b]) for a, b in [(1, 2), (1, 3), (1, 4), (5, 6), (1, 5)]], "a int, b int, x string, y string")
    like = {(r.a, r.b): r.near for r in pairs.select("a", "b", op13_imatch.likeness("x", "y").alias("near")).collect()}
    assert like[1, 2] == 1 and like[5, 6] == 1 and like[1, 4] == 0 and like[1, 5] == 0 and 0.3 < like[1, 3] < 1
    clash = op13_imatch.with_fingerprints(df, op13_imatch.lexicon(df), {"fingerprint": "text"})
    assert sorted(clash.columns) == sorted(df.columns) and {r.terms for r in clash.collect()} == {1}
    assert op13_imatch.fingerprints(df.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", ["1", "7"])
def test_next_rows(spark, buckets):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        rng = random.Random(4)
        rows = [(rng.choice([None, 1 - (1 << 63), rng.randint(-500, 500)]), f"t{rng.randint(0, 9)}") for _ in range(600)]
        order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
        want = Counter((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order))
        df = spark.createDataFrame(rows, "k long, t string").repartition(4)
        assert Counter(tuple(r) for r in with_next(df, "k", "t", {"after": F.col("t")}).collect()) == want
        one = with_next(df.limit(0).union(spark.createDataFrame([(3, "x")], "k long, t string")), "k", "t", {"after": F.col("t")})
        assert [tuple(r) for r in one.collect()] == [(3, "x", "x")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
