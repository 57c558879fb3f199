"""Note text operators (G1-G11): dedup, same-day merge, clean-up, n-gram counts,
TF-IDF, term frequencies and normalisation, all as Spark built-ins.

Long form everywhere: a document-term table ``(doc, term, count)``. The
vocabulary is capped by a parameter, so every table joined to the long form
on ``term`` (vocabulary, document frequencies, column sums) has a known
upper bound on its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairos.functions.text import ngrams_1_2, tokens, word_count
from kairos.operators.rows import attach


def dedup_texts(notes: DataFrame, *, key: str = "patient_id", text: str = "note_text",
                order: Sequence[str] = ("note_id",)) -> DataFrame:
    """G1: drop exact duplicate texts per patient, keeping the first by ``order``.

    Grouped by (patient, 64-bit hash of the text, text) with a partial
    ``min`` of the order key, so many copies of one text collapse map-side
    before the shuffle; equal hashes are confirmed on the text itself. The
    kept ids select the rows back (semi join on the id).
    """
    o = list(order)[0]
    keep = notes.groupBy(key, F.xxhash64(text).alias("_h"), text).agg(F.min(o).alias(o)).select(o)
    return notes.join(keep, o, "left_semi")


def same_day_concat(notes: DataFrame, *, keys: Sequence[str] = ("patient_id", "contact_date", "update_date"),
                    text: str = "note_text", order: str = "note_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per (patient, contact day, update day): texts joined by a space in
    ``order``; other ``keep`` columns from the first row (first non-null, S2)."""
    st = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    aggs = [F.array_join(F.transform(st, lambda x: x["t"]), " ").alias(text), F.min(order).alias(order)]
    aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in keep]
    return notes.groupBy(*keys).agg(*aggs)


def clean_tokens(notes: DataFrame, lemmas: DataFrame, stop: DataFrame, *, doc: str = "note_id",
                 text: str = "note_text", out: str = "clean_text") -> DataFrame:
    """G5 re-aimed as tables: tokens -> lemma lookup -> stop-list removal -> text.

    Tokens are whitespace pieces in order (``posexplode``); ``lemmas`` is a
    ``(token, lemma)`` table, ``stop`` a ``(token)`` list compared in lower
    case; the kept tokens are joined in order, punctuation is removed and
    spaces collapsed. Documents whose tokens are all removed come out empty.
    """
    toks = notes.select(doc, text) \
        .select(doc, F.posexplode(F.split(F.col(text), r"\s+")).alias("pos", "token")) \
        .filter(F.length("token") > 0)
    lem = lemmas.select("token", F.col("lemma"))
    toks = toks.join(lem, "token", "left").withColumn("word", F.coalesce("lemma", "token"))
    toks = toks.join(stop.select(F.lower("token").alias("_stop")), F.lower(F.col("word")) == F.col("_stop"),
                     "left_anti")
    joined = toks.groupBy(doc).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("_t"))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace("_t", r"\p{Punct}", ""), r"\s+", " "))
    out_df = notes.select(doc).join(joined, doc, "left")
    return out_df.select(doc, F.coalesce(cleaned, F.lit("")).alias(out))


def token_totals(docs: DataFrame, *, text: str = "note_text") -> DataFrame:
    """``(token, n)`` of the lower-case whitespace tokens of a corpus: one pass over the texts, counted before the shuffle."""
    t = docs.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("token")).filter(F.length("token") > 0)
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def plural_lemmas(totals: DataFrame) -> DataFrame:
    """A ``(token, lemma)`` table derived from the corpus (its ``token_totals``)
    by one rule: a lower-case token ending in ``s`` whose stem without the ``s``
    is also a token maps to the stem. (The reference's part-of-speech lemmatiser
    is a per-row library; G5 takes the table as input.)"""
    stems = totals.filter(F.col("token").endswith("s") & (F.length("token") > 3)) \
        .select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return stems.join(totals.select(F.col("token").alias("lemma")), "lemma", "left_semi").select("token", "lemma")


def with_word_count(notes: DataFrame, *, text: str = "note_text", min_words: int = 10) -> DataFrame:
    """Word count (spaces - 1) and the minimum-length filter."""
    return notes.withColumn("word_count", word_count(text)).filter(F.col("word_count") >= min_words)


def term_counts(docs: DataFrame, *, doc: str = "note_id", text: str = "note_text") -> DataFrame:
    """``(doc, term, count)`` of unigrams and bigrams; map-side partial counts."""
    t = docs.select(doc, text).select(doc, tokens(text).alias("_toks")) \
        .select(doc, F.explode(ngrams_1_2("_toks")).alias("term"))
    return t.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("count"))


def term_totals(docs: DataFrame, *, doc: str = "note_id", text: str = "note_text") -> DataFrame:
    """Corpus-wide ``(term, total)`` straight from the token stream: map-side
    partial counts per term, no per-document rows."""
    t = docs.select(doc, text).select(tokens(text).alias("_toks")) \
        .select(F.explode(ngrams_1_2("_toks")).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def vocab_counts(docs: DataFrame, vocab: DataFrame, *, doc: str = "note_id", text: str = "note_text") -> DataFrame:
    """``(doc, term, count)`` restricted to a vocabulary: the (bounded, broadcast)
    vocabulary filters the token stream before the per-document shuffle."""
    t = docs.select(doc, text).select(doc, tokens(text).alias("_toks")) \
        .select(doc, F.explode(ngrams_1_2("_toks")).alias("term"))
    t = t.join(F.broadcast(vocab.select("term")), "term", "left_semi")
    return t.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(counts: DataFrame, *, max_features: int, doc: str = "note_id",
               train_docs: DataFrame | None = None) -> DataFrame:
    """The ``max_features`` terms with the highest total count on training
    documents (ties by term), with their index in alphabetical order.

    ``counts`` is ``(doc, term, count)`` or, without ``train_docs``, the
    ``(term, count)`` totals of the training documents. Take-ordered
    (``orderBy.limit``) keeps at most ``max_features`` rows per partition;
    the result is bounded by ``max_features``.
    """
    c = counts.join(train_docs.select(doc), doc, "left_semi") if train_docs is not None else counts
    tot = c.groupBy("term").agg(F.sum("count").alias("total"))
    top = tot.orderBy(F.col("total").desc(), F.col("term").asc()).limit(max_features)
    w = Window.orderBy("term")  # at most max_features rows
    return top.withColumn("index", F.row_number().over(w) - 1)


def tfidf(counts: DataFrame, vocab: DataFrame, *, doc: str = "note_id", train_docs: DataFrame | None = None) -> DataFrame:
    """TF-IDF on the vocabulary (S12): ``idf = ln((1+n)/(1+df)) + 1`` with n and df
    on training documents, raw counts as tf, L2 norm per document.

    ``counts`` must have one row per (doc, term) (``vocab_counts`` / ``term_counts``)."""
    v = F.broadcast(vocab.select("term"))  # bounded by max_features
    c = counts.join(v, "term")
    tr = c.join(train_docs.select(doc), doc, "left_semi") if train_docs is not None else c
    n = (train_docs.select(doc).distinct() if train_docs is not None else counts.select(doc).distinct()) \
        .agg(F.count(F.lit(1)).alias("_n"))
    df = tr.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))  # (doc, term) rows are unique
    idf = attach(vocab.select("term").join(df, "term", "left").fillna({"_df": 0}), n, [])
    idf = idf.select("term", (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("_df"))) + F.lit(1.0)).alias("idf"))
    x = c.join(F.broadcast(idf), "term").withColumn("_x", F.col("count") * F.col("idf"))
    norm = x.groupBy(doc).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    return x.join(norm, doc).select(doc, "term", (F.col("_x") / F.col("_norm")).alias("tfidf"))


def term_frequency(counts: DataFrame, docs: DataFrame, vocab: DataFrame, *, doc: str = "note_id") -> DataFrame:
    """Count / word_count for the terms of a given vocabulary."""
    c = counts.join(F.broadcast(vocab.select("term")), "term")
    return c.join(docs.select(doc, "word_count"), doc).select(
        doc, "term", (F.col("count") / F.col("word_count")).alias("tf"))


def column_normalize(tf: DataFrame, *, value: str = "tf", doc: str = "note_id",
                     over_docs: DataFrame | None = None) -> DataFrame:
    """Each term's values divided by the term's sum over documents.

    ``over_docs`` limits the sums to those documents (train only, the
    default in ``plans``); ``None`` sums over all, as the reference did.
    The per-term sums are one row per vocabulary term (bounded), joined back.
    """
    src = tf.join(over_docs.select(doc), doc, "left_semi") if over_docs is not None else tf
    sums = src.groupBy("term").agg(F.sum(value).alias("_colsum"))
    return tf.join(F.broadcast(sums), "term").select(doc, "term", (F.col(value) / F.col("_colsum")).alias(value))


def apply_edited_vocab(df: DataFrame, edited: DataFrame, *, term: str = "term") -> DataFrame:
    """Keep the terms of an edited vocabulary whose ``exclude`` flag is 0."""
    keep = edited.filter(F.col("exclude") == 0).select(F.col("feature").alias(term))
    return df.join(F.broadcast(keep), term, "left_semi")
