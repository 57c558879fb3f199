"""Line dedup and quality rules against brute force."""

import re
from collections import Counter

import pytest

from kairos.llm import op5_quality, op10_line_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    """{(doc, line): first earlier match} over all pairs of lines."""
    lines = sorted({(d, i, frozenset(WORD.findall(x.translate(LOWER)))) for d, t in rows if d is not None and t
                    for i, x in enumerate(t.split("\n"))}, key=lambda r: r[:2])
    lines = [r for r in lines if len(r[2]) >= op10_line_dedup.MIN_WORDS]
    out = {}
    for k, (d, i, s) in enumerate(lines):
        for e, j, r in lines[:k]:
            if 5 * len(s & r) >= 4 * len(s | r):
                out[d, i] = (e, j)
                break
    return out


def texts():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rows = [(0, " ".join(base) + "\nshort line here"), (1, "intro words that differ a lot\n" + " ".join(base)),
            (2, " ".join(base[:18] + ["phi", "chi"])), (3, " ".join(base[:12])), (4, None), (5, ""), (6, "\n\n  \n"),
            (7, "the the the the the the"), (None, " ".join(base)), (9, " ".join(reversed(base)).upper()), (9, " ".join(reversed(base)).upper())]
    for k in range(60):  # a clump of near copies
        words = [f"w{j}" for j in range(40)]
        words[k % 40] = f"x{k}"
        words[(3 * k + 1) % 40] = f"y{k}"
        rows.append((100 + k, "first of %d and so on we go\n" % k + " ".join(words)))
    rows += [(200 + k, "Ünïcode wörds — müssen auch gehen, nicht wahr, oder doch\nshort line here") for k in range(3)]
    rows.append((300, " ".join(f"long{k}" for k in range(30000))))
    rows.append((301, " ".join(f"long{k}" for k in range(29000))))
    return rows


@pytest.mark.parametrize("crowd", [op10_line_dedup.CROWD, 8])
def test_line_matches(spark, crowd):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone, compared = op10_line_dedup.removed_lines(df, crowd=crowd)
    got = {(r.doc_id, r.line): (r.match_doc, r.match_line) for r in gone.collect()}
    want = brute_lines(rows)
    assert got == want
    assert compared.filter("doc_id = 300").count() == 1


def test_short_lines_are_compared(spark):
    """Lines of one to four distinct words: equal sets match whatever the lines' length, 4 of 5 words match, 3 of 4 do not."""
    long = " ".join(["onon", "ingstin", "ingstin", "Ingstin"] * 30)
    rows = [(1, "solo\na b\nthree word line"), (2, "SOLO\nb a a\n" + long), (3, long + "\nline three word word\n\n \n"),
            (4, "p q r s t"), (5, "s r q p"), (6, "q r s"), (7, "t s r p"), (None, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone, compared = op10_line_dedup.removed_lines(df)
    assert {(r.doc_id, r.line): (r.match_doc, r.match_line) for r in gone.collect()} == {
        (2, 0): (1, 0), (2, 1): (1, 1), (3, 0): (2, 2), (3, 1): (1, 2), (5, 0): (4, 0), (7, 0): (4, 0)}
    assert compared.filter("doc_id is not null").count() == 12


def test_one_id_with_several_texts(spark):
    """Rows of one doc_id with different texts: a line number means each row's own line, and nothing breaks."""
    line = "some words that stand in both of the texts here"
    rows = [(1, "first line of the longer text goes here\n" * 40 + line), (1, "x"), (1, ""), (2, line), (2, "y\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone, _ = op10_line_dedup.removed_lines(df)
    got = {(r.doc_id, r.line) for r in gone.collect()}
    assert {(2, 0), (2, 1)} <= got and (1, 0) not in got and len([g for g in got if g[0] == 1]) == 39


def test_dedup_lines_keeps_columns_and_drops_emptied(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t in texts()], "doc_id long, text string, line string")
    out = {r.doc_id: r.text for r in op10_line_dedup.dedup_lines(df).collect()}
    assert 2 not in out and 9 not in out and out[1] == "intro words that differ a lot"
    assert out[4] is None and out[5] == "" and out[6] == "\n\n  \n" and out[3] is not None
    assert out[200].endswith("oder doch") and 201 not in out and 202 not in out and None in out  # their lines repeat those of 0 and 200


def test_lines_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    gone, _ = op10_line_dedup.removed_lines(docs)
    assert {(r.doc_id, r.line): (r.match_doc, r.match_line) for r in gone.collect()} == brute_lines(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op10_line_dedup.removed_lines(df)[0].count() == 0
    assert op10_line_dedup.dedup_lines(df).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = op5_quality.train(df, labels)
    assert op5_quality.rules(df, model).count() == 0


def brute_base(t):
    t = t or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if n[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_base_counts(spark):
    extra = [(10_001, None), (10_002, ""), (10_003, "a b c a b c d\n\na b\na b\n \n"), (10_004, "é\x00 \x85x y #|<"), (10_004, "x\n x\nx"),
             (10_005, "so " * 70_000), (None, "hello world")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    model = op5_quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter((r.doc_id, *[r[c] for c in cols], r.base_failed) for r in op5_quality.rules(docs, model).collect())
    want = Counter()
    for d, t in [tuple(r) for r in docs.collect()]:
        b = brute_base(t)
        want[(d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want
