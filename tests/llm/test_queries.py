"""The registered queries themselves, on whole small tables, where SQL cannot check them."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from kairos.llm import op2_bpe, op5_quality, op7_toxicity, queries
from tests.llm.test_lines_quality import WORD, brute_base, brute_lines
from tests.llm.test_operators import brute_components, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op2_byte_bpe(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    enc = op2_bpe.encoder(op2_bpe.read_ranks(queries.ranks_path()), P.PATTERN)
    want = Counter()
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        want[(d, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))] += 1
    assert Counter(tuple(r) for r in run(spark, "op2_byte_bpe")) == want
    assert {t.name for t in spark.catalog.listTables()} == before  # no table is left in the catalog


def test_op3_token_counts(spark, docs):
    enc = op2_bpe.encoder(op2_bpe.read_ranks(queries.ranks_path()), P.PATTERN)
    n = [len(enc.encode_ordinary(t or "")) for _, t in docs]
    got = {r.length: (r.n_docs, r.docs_from, r.tokens_from, r.total_cut) for r in run(spark, "op3_token_counts")}
    assert got == {x: (n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(min(x, y) for y in n)) for x in n}


def test_op5_quality_rules(spark, docs):
    rows = run(spark, "op5_quality_rules")
    base = {d: brute_base(t) for d, t in docs}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        b = base[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert r.base_failed == failed and 0 <= r.score <= 1
        assert r.kept == (not failed and r.score >= op5_quality.THRESHOLD) or abs(r.score - op5_quality.THRESHOLD) < 1e-6
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert len(rows) == len(docs) and sum(good) > 0.9 * len(good) and sum(bad) < 0.2 * max(len(bad), 1)


def test_op5_score_of_rows_that_the_fit_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op5_quality.train(docs, labels, where=~op7_toxicity.held_out())
    rows = op5_quality.rules(docs, model).join(labels.filter(op7_toxicity.held_out()), "doc_id").select("score", "quality").collect()
    right = sum((r.score >= op5_quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right > 0.85 * len(rows)


def test_op6_simhash(spark, docs):
    prints = {t: brute_print(t) for _, t in docs}
    roots = brute_components(set(prints.values()))
    low = {}
    for d, t in docs:
        low[roots[prints[t]]] = min(low.get(roots[prints[t]], d), d)
    assert Counter(tuple(r) for r in run(spark, "op6_simhash_near_dedup")) == Counter((d, f"{prints[t]:016x}", low[roots[prints[t]]]) for d, t in docs)


def test_op7_toxicity(spark, docs):
    import zlib
    rows = run(spark, "op7_toxicity_scores")
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_op7_on_rows_that_the_fit_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op7_toxicity_scores"](spark, sf).filter("held_out").collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if labels.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(a == b for a, b in held) > 0.9 * len(held)  # learned from about 300 rows


def test_op10_line_dedup(spark, docs):
    gone = brute_lines(docs)
    want = {}
    for d, t in docs:
        lines = [i for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        mine = {i: m for (doc, i), m in gone.items() if doc == d}
        match = sorted({m[0] for m in mine.values()})
        want[d] = (len(lines), len(mine), ",".join(map(str, sorted(mine))), match, len(match))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines, r.matched_docs, r.n_links) for r in run(spark, "op10_line_dedup")} == want
