"""Contract queries: note text (G1-G11, B20, K15) and decayed term vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairos.functions import text as tx
from kairos.operators import pit
from kairos.operators import text as tops
from kairos.plans.registry import query, r
from kairos.sources import fixtures as fx

TOKENS_SQL = r"regexp_extract_all(lower(note_text), '[\p{L}\p{N}_]{2,}')"
# unigrams + bigrams of a token list t (DuckDB lists are 1-based)
NGRAMS_SQL = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
VOCAB_N = 10000  # the vocabulary parameter of the vectoriser


def _spread_notes(spark, sf_dir, *columns):
    """Notes for work on whole texts. An input of fewer splits than there are cores (few row groups) is dealt out once, since one task
    would read it all; an input of many splits is read where it is, without a shuffle."""
    n = fx.notes(spark, sf_dir).select(*columns)
    splits, cores = fx.table(spark, sf_dir, "documents").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return n if splits >= cores else n.repartition(cores)


def _train_notes(notes):
    return notes.filter(F.col("note_id") % 10 < 8).select("note_id")


@query("g1_dedup", "G1", """
select note_id, patient_id from (
  select note_id, patient_id, row_number() over (partition by patient_id, note_text order by note_id) as rn from notes)
where rn = 1
""")
def g1_dedup(spark, sf_dir):
    return tops.dedup_texts(fx.notes(spark, sf_dir)).select("note_id", "patient_id")


@query("g2_same_day", "G2 S2", """
select patient_id, contact_date, update_date, min(note_id) as note_id,
  md5(string_agg(note_text, ' ' order by note_id)) as text_md5, min_by(department, note_id) as department
from notes group by patient_id, contact_date, update_date
""")
def g2_same_day(spark, sf_dir):
    g = tops.same_day_concat(fx.notes(spark, sf_dir), keep=["department"])
    return g.select("patient_id", "contact_date", "update_date", "note_id", F.md5("note_text").alias("text_md5"),
                    "department")


_NAMES_SQL = """
select c_custkey as patient_id, split_part(c_name, '#', 1) as firstname, split_part(c_name, '#', 2) as lastname
from customer
"""


@query("g3_remove_names", "G3 S19", r"""
with p as (select n.note_id, n.note_text,
             list_filter([nm.firstname, nm.lastname], lambda x: x is not null and length(x) > 0) as parts
           from notes n join names nm on nm.patient_id = n.patient_id)
select note_id, md5(case when len(parts) > 0 then regexp_replace(note_text,
    '(?i)' || array_to_string(list_transform(parts, lambda x: '\Q' || replace(x, '\E', '\E\\E\Q') || '\E'), '|'), '', 'g')
  else note_text end) as text_md5
from p
""", extra_views={"names": _NAMES_SQL})
def g3_remove_names(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("firstname"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("lastname"))
    n = fx.notes(spark, sf_dir).join(c, "patient_id")
    return n.select("note_id", F.md5(tx.remove_names("note_text", "firstname", "lastname")).alias("text_md5"))


_W = "['zero','one','two','three','four','five','six','seven','eight','nine']"
_T = "['ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


@query("g4_number_words", "G4 S11", rf"""
with s as (select note_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(note_text, '\.[0-9]+', '', 'g'),
             '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g') as t from notes),
r as (select note_id, regexp_extract_all(t, '[0-9]+|[^0-9]+') as runs from s)
select note_id, md5(array_to_string(list_transform(runs, lambda x, i:
  case when not regexp_full_match(x, '[0-9]+') then x
       when i = 1 or i = len(runs) then ''
       when length(x) = 1 then {_W}[cast(x as int) + 1]
       when length(x) = 2 and substr(x, 1, 1) <> '0' then {_T}[cast(substr(x, 1, 1) as int)]
       when length(x) = 3 and substr(x, 1, 1) = '1' then 'onehundred'
       else '' end), '')) as text_md5
from r
""")
def g4_number_words(spark, sf_dir):
    n = _spread_notes(spark, sf_dir, "note_id", "note_text")
    return n.select("note_id", F.md5(tx.numbers_to_words("note_text")).alias("text_md5"))


_LEMMA_SQL = r"""
select distinct token, substr(token, 1, length(token) - 1) as lemma from (
  select distinct unnest(string_split_regex(lower(note_text), '\s+')) as token from notes) v
where token like '%s' and length(token) > 3
  and substr(token, 1, length(token) - 1) in (select unnest(string_split_regex(lower(note_text), '\s+')) from notes)
"""
_STOP_SQL = r"""
select token from (select lower(tok) as token, count(*) as n from (
  select unnest(string_split_regex(note_text, '\s+')) as tok from notes) where length(tok) > 0
  group by lower(tok) order by n desc, token limit 5)
"""


@query("g5_clean_tokens", "G5 D11", r"""
with t as (select note_id, unnest(toks) as token, unnest(range(len(toks))) as pos
           from (select note_id, string_split_regex(note_text, '\s+') as toks from notes)),
w as (select t.note_id, t.pos, coalesce(l.lemma, t.token) as word from t left join lemmas l on l.token = t.token
      where length(t.token) > 0),
k as (select * from w where lower(word) not in (select token from stops)),
j as (select note_id, string_agg(word, ' ' order by pos) as txt from k group by note_id)
select n.note_id, md5(coalesce(trim(regexp_replace(regexp_replace(j.txt, '[[:punct:]]', '', 'g'), '\s+', ' ', 'g')), '')) as text_md5
from notes n left join j on j.note_id = n.note_id
""", extra_views={"lemmas": _LEMMA_SQL, "stops": _STOP_SQL})
def g5_clean_tokens(spark, sf_dir):
    from kairos.operators.dedup import top_n_by_frequency
    from kairos.sources.writers import persist_table
    notes = _spread_notes(spark, sf_dir, "note_id", "note_text")
    totals = persist_table(tops.token_totals(notes), "token_totals")  # a row per distinct token, for lemmas and stop words
    lem = tops.plural_lemmas(totals)
    stop = top_n_by_frequency(totals, "token", 5, count="n").select("token")
    out = tops.clean_tokens(notes, lem, F.broadcast(stop))  # five rows
    return out.select("note_id", F.md5("clean_text").alias("text_md5"))


@query("g6_word_count", "G6", """
select note_id, cast(length(note_text) - length(replace(note_text, ' ', '')) - 1 as int) as word_count
from notes where length(note_text) - length(replace(note_text, ' ', '')) - 1 >= 10
""")
def g6_word_count(spark, sf_dir):
    return tops.with_word_count(fx.notes(spark, sf_dir)).select("note_id", F.col("word_count").cast("int"))


_COUNTS_SQL = f"""
select note_id, term, count(*) as cnt from (
  select note_id, unnest({NGRAMS_SQL}) as term from (select note_id, {TOKENS_SQL} as t from notes))
group by note_id, term
"""
_VOCAB_SQL = f"""
select term, total, cast(row_number() over (order by term) - 1 as int) as index from (
  select term, sum(cnt) as total from counts where note_id % 10 < 8 group by term
  order by total desc, term limit {VOCAB_N})
"""


def _counts(spark, sf_dir):
    n = fx.notes(spark, sf_dir)
    return n, tops.term_counts(n)


def _vocab(notes, n_terms, materialize: bool = False):
    """Vocabulary of the training notes, from corpus totals (no per-document rows).

    ``materialize`` writes it (at most ``n_terms`` rows) once to the shared
    folder when several branches of a plan read it."""
    v = tops.vocabulary(tops.term_totals(notes.filter(F.col("note_id") % 10 < 8)), max_features=n_terms)
    if materialize:
        from kairos.sources.writers import persist_table
        v = persist_table(v, "vocab")
    return v


def _counts_and_vocab(notes):
    """(doc-term counts within the vocabulary, vocabulary): the vocabulary comes from corpus totals, and the counts are
    filtered by it before any document's terms are shuffled; only terms of the vocabulary are written."""
    from kairos.sources.writers import persist_table
    v = _vocab(notes, VOCAB_N, materialize=True)
    return persist_table(tops.vocab_counts(notes, v), "doc_term_counts"), v


@query("g7_vocabulary", "G7", """
select term, cast(total as bigint) as total, index from vocab
""", extra_views={"counts": _COUNTS_SQL, "vocab": _VOCAB_SQL})
def g7_vocabulary(spark, sf_dir):
    v = _vocab(_spread_notes(spark, sf_dir, "note_id", "note_text"), VOCAB_N)
    return v.select("term", F.col("total").cast("long"), F.col("index").cast("int"))


@query("g8_tfidf", "G8 S12", """
with n as (select count(distinct note_id) as n from notes where note_id % 10 < 8),
c as (select c.* from counts c join vocab v on v.term = c.term),
df as (select term, count(distinct note_id) as df from c where note_id % 10 < 8 group by term),
idf as (select v.term, ln((1e0 + n.n) / (1e0 + coalesce(df.df, 0))) + 1e0 as idf from vocab v left join df on df.term = v.term, n),
x as (select c.note_id, c.term, c.cnt * idf.idf as x from c join idf on idf.term = c.term),
nm as (select note_id, sqrt(sum(x * x)) as norm from x group by note_id)
select x.note_id, cast(count(*) as bigint) as n_terms, round(sum(x.x / nm.norm), 6) as sum_tfidf,
  round(max(x.x / nm.norm), 6) as max_tfidf
from x join nm on nm.note_id = x.note_id group by x.note_id
""", extra_views={"counts": _COUNTS_SQL, "vocab": _VOCAB_SQL})
def g8_tfidf(spark, sf_dir):
    n = _spread_notes(spark, sf_dir, "note_id", "note_text")
    tr = _train_notes(n)
    c, v = _counts_and_vocab(n)
    t = tops.tfidf(c, v, train_docs=tr)
    return t.groupBy("note_id").agg(F.count(F.lit(1)).alias("n_terms"), r(F.sum("tfidf"), 6).alias("sum_tfidf"),
                                    r(F.max("tfidf"), 6).alias("max_tfidf"))


_EDITED_SQL = """
select term as feature, case when regexp_matches(term, '[0-9]') or length(term) < 3 then 1 else 0 end as exclude from vocab
"""


@query("g9_g11_term_frequency", "G9 G10 G11", """
with keep as (select feature as term from edited where exclude = 0),
wc as (select note_id, length(note_text) - length(replace(note_text, ' ', '')) - 1 as word_count from notes
       where length(note_text) - length(replace(note_text, ' ', '')) - 1 >= 10),
tf as (select c.note_id, c.term, c.cnt / wc.word_count as tf from counts c join keep k on k.term = c.term
       join wc on wc.note_id = c.note_id),
s as (select term, sum(tf) as colsum from tf where note_id % 10 < 8 group by term),
z as (select tf.note_id, tf.term, tf.tf / s.colsum as v from tf join s on s.term = tf.term)
select term, cast(count(*) as bigint) as n_docs, round(sum(v), 6) as sum_all,
  round(sum(case when note_id % 10 < 8 then v else 0e0 end), 6) as sum_train
from z group by term
""", extra_views={"counts": _COUNTS_SQL, "vocab": _VOCAB_SQL, "edited": _EDITED_SQL})
def g9_g11_term_frequency(spark, sf_dir):
    n = _spread_notes(spark, sf_dir, "note_id", "note_text")
    tr = _train_notes(n)
    c, v = _counts_and_vocab(n)
    edited = v.select(F.col("term").alias("feature"),
                      F.when(F.col("term").rlike("[0-9]") | (F.length("term") < 3), 1).otherwise(0).alias("exclude"))
    docs = tops.with_word_count(n)
    tf = tops.term_frequency(tops.apply_edited_vocab(c, edited), docs, v)
    z = tops.column_normalize(tf, over_docs=tr)
    is_tr = F.col("note_id") % 10 < 8
    return z.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), r(F.sum("tf"), 6).alias("sum_all"),
                                 r(F.sum(F.when(is_tr, F.col("tf")).otherwise(F.lit(0.0))), 6).alias("sum_train"))


@query("f3_decayed_terms", "F3 G9 C5", """
with wc as (select note_id, patient_id, update_date, length(note_text) - length(replace(note_text, ' ', '')) - 1 as word_count
            from notes where length(note_text) - length(replace(note_text, ' ', '')) - 1 >= 10),
tf as (select c.note_id, c.term, c.cnt / wc.word_count as tf from counts c join vocab f on f.term = c.term
       join wc on wc.note_id = c.note_id),
p as (select v.visit_id, wc.note_id, pow(2e0, -datediff('day', wc.update_date, v.visit_date) / 30e0) as w
      from visits v join wc on wc.patient_id = v.patient_id and wc.update_date <= v.visit_date
       and wc.update_date > v.visit_date - interval 365 day),
t as (select visit_id, sum(w) as tw from p group by visit_id)
select p.visit_id, tf.term, round(sum(p.w / t.tw * tf.tf), 6) as value
from p join t on t.visit_id = p.visit_id join tf on tf.note_id = p.note_id group by p.visit_id, tf.term
""", extra_views={"counts": _COUNTS_SQL, "vocab": _VOCAB_SQL})
def f3_decayed_terms(spark, sf_dir):
    n = _spread_notes(spark, sf_dir, "note_id", "patient_id", "update_date", "note_text")
    c, feats = _counts_and_vocab(n)
    docs = tops.with_word_count(n)
    tf = tops.term_frequency(c, docs, feats).select("note_id", "term", F.col("tf").alias("value"))
    out = pit.decayed_term_mean(fx.visits(spark, sf_dir), docs, tf, note_time="update_date")
    return out.select("visit_id", "term", r("value", 6).alias("value"))


_SIGNED_SQL = """
select patient_id, string_agg(distinct (case when feature_name like 'diag%' then '+' else '-' end) || feature_name, ' '
  order by (case when feature_name like 'diag%' then '+' else '-' end) || feature_name) as feats
from items group by patient_id
"""


@query("b20_k15_terms", "B20 K15 S18", r"""
with t as (select trim(unnest(regexp_extract_all(feats, '[+-][^+-]*'))) as term from signed)
select term, cast(count(*) as bigint) as n from t where length(term) > 1 group by term
""", extra_views={"signed": _SIGNED_SQL})
def b20_k15_terms(spark, sf_dir):
    from kairos.operators.metrics import term_counts
    it = fx.items(spark, sf_dir)
    sign = F.when(F.col("feature_name").startswith("diag"), F.lit("+")).otherwise(F.lit("-"))
    s = it.groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(sign, "feature_name"))), " ")
                                     .alias("feats"))
    return term_counts(s.select(tx.signed_terms("feats").alias("terms")), "terms")
