"""Token counts from an exact length histogram.

Documents are aggregated by encoded length (a partial aggregation: one row a
task and length is shuffled, whatever the number of documents). Suffix sums
over the histogram then answer, for every context limit, how many documents
reach it, the tokens in them, the total when every document is cut there,
and the quantile it stands for. The suffix sums run inside length ranges
with offsets from range totals, so no task sees the whole histogram.

Defined cases: null and empty texts have length 0; an empty table gives an
empty histogram; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import shared, trim
from kairos.llm.op2_bpe import encoder_of
from kairos.operators.running import running_sum

#: Lengths that share a range of the suffix sums.
RANGE = 1024


def _lengths(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        encode = encoder_of(ranks_path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["length"])
    return run


def histogram(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """length, n_docs: how many documents have each encoded length."""
    texts = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_lengths(ranks_path, pattern), "length bigint").groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: documents and tokens at or above it, the total cut at it, and the share of documents up to it.

    total_cut(L) = tokens of shorter documents + L for each other document.
    """
    hist = shared(hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")), "length-histogram")
    up = running_sum(hist, ["length"], ["n_docs", "n_tokens"], descending=True, bucket=F.floor(F.col("length") / RANGE),
                     out_prefix="ge_")
    docs, tokens = (hist.agg(F.sum(c)).scalar() for c in ("n_docs", "n_tokens"))
    return up.select(
        "length", "n_docs", F.col("ge_n_docs").cast("long").alias("docs_from"), F.col("ge_n_tokens").cast("long").alias("tokens_from"),
        (tokens - F.col("ge_n_tokens") + F.col("length") * F.col("ge_n_docs")).cast("long").alias("total_cut"),
        ((docs - F.col("ge_n_docs") + F.col("n_docs")) / docs).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Documents that reach each context limit, tokens kept when every text is cut there, and tokens lost.

    A limit between two lengths of the histogram has the suffix of the next one.
    """
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context long")
    tokens = F.coalesce(sums.agg(F.sum(F.col("length") * F.col("n_docs"))).scalar(), F.lit(0))
    # every length goes to the limits it reaches; the shortest of them holds the suffix (one row a limit and task is shuffled)
    reached = F.explode(F.filter(F.array(*[F.lit(int(x)).cast("long") for x in limits]), lambda x: x <= F.col("length")))
    reach = sums.select("*", reached.alias("context")).groupBy("context").agg(F.min(F.struct("length", "docs_from", "tokens_from")).alias("at"))
    from_, in_ = (F.coalesce(F.col(f"at.{c}"), F.lit(0)) for c in ("docs_from", "tokens_from"))
    return wanted.join(reach, "context", "left").select(
        "context", from_.alias("docs_from"), (tokens - in_ + F.col("context") * from_).alias("total_cut"))
