"""The corpus pipeline against brute force, stage by stage, and its contract."""

import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from kairos.llm import op2_bpe, op7_toxicity
from tests.llm.test_lines_quality import WORD, brute_lines
from tests.llm.test_operators import RANKS, brute_components, brute_contamination, brute_print

SF = "/root/testdata/sf0.001"


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and list(corpus_pipeline.QUERIES) == ["pipeline"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = op7_toxicity.train(docs, labels, where=~op7_toxicity.held_out())
    kept = [(r.doc_id, r.text) for r in op7_toxicity.scored(docs, model).collect() if r.score < op7_toxicity.THRESHOLD]
    gone = brute_lines(kept)
    cut = []
    for d, t in kept:
        lines = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if len(lines) == len(t.split("\n")) or WORD.search("\n".join(lines)):
            cut.append((d, "\n".join(lines)))
    prints = {t: brute_print(t) for _, t in cut}
    roots = brute_components(set(prints.values()))
    low = {}
    for d, t in cut:
        low[roots[prints[t]]] = min(low.get(roots[prints[t]], d), d)
    one = [(d, t) for d, t in cut if low[roots[prints[t]]] == d]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, n, hit, _ in brute_contamination(one, items) if hit and 20 * hit >= n}
    enc = op2_bpe.encoder(op2_bpe.read_ranks(RANKS), P.PATTERN)
    want = {d: (enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in one if d not in bad}
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    """Nulls in any column, empty texts, repeated rows and empty tables pass every stage; columns stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (5000, None, "en", None, None), (5001, "", None, "s", 0), (5002, "  \n ", "en", "s", 4),
           (5003, "same words here and there again", "en", "s", 1), (5003, "same words here and there again", "en", "s", 1),
           (None, "a text without an id at all", "en", "s", 3)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = stage(spark, rows, SF)
    n = out.count()
    assert 0 < n <= rows.count()
    if name != "byte_bpe":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_encoding_stage_decodes_where_it_reassembles(spark):
    docs = spark.createDataFrame([(1, "one two\n"), (1, "one two\n"), (2, ""), (3, None), (4, "naïve 文字 x" * 50)], "doc_id long, text string")
    made = corpus_pipeline.encode(spark, docs, SF)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # word lists; reassembling and decoding
    ids = op2_bpe.encode(docs, RANKS, P.PATTERN)
    rows = lambda df: sorted((r.doc_id, list(r.ids), bytes(r.bytes)) for r in df.collect())
    assert rows(op2_bpe.encode_and_decode(docs, RANKS, P.PATTERN)) == rows(op2_bpe.decode(ids, RANKS))
    assert sorted(op2_bpe.encode_and_digest(docs, RANKS, P.PATTERN).collect()) == sorted(op2_bpe.digests(ids, RANKS).collect())
