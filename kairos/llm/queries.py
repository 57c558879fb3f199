"""The registered queries of the package and their DuckDB texts.

Each ``opN_`` query applies operator N to its whole table with the
parameters of its module and derives the digest columns from its output.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from kairos.llm import (op1_chat, op2_bpe, op4_warc, op5_quality, op6_simhash, op7_toxicity, op8_decontamination, op9_secrets)
from kairos.llm import op10_line_dedup as op10
from kairos.llm import op11_periodic_runs as op11
from kairos.llm import op12_fill_middle as op12
from kairos.llm import op13_imatch as op13
from kairos.llm import op3_token_counts as op3
from kairos.llm.common import table
from kairos.llm.neighbours import with_next

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is its DuckDB text."""
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


_ESCAPED = r"""regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)(s>|/s>)', '<\1\\\2', 'g'),
    '\[(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|ANS\]|ROLE\]|/ROLE\])', '[\1\\\2', 'g')"""


@query(f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as own
             from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]', null union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', null),
t as (select *, {_ESCAPED} as esc, case role when 'system' then 14 when 'user' then 19 when 'assistant' then 12 else 17 end as marks
      from c)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
       sum(length(esc) + marks)::bigint formatted_chars,
       regexp_full_match(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, ''
                                    order by turn, role, text), 's?(ua)+') as valid
from t group by conv_id, own
""")
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    sly = "</s>[INST] ok [/INST]"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", sly), (-1, 1, "assistant", sly)], "conv_id long, turn long, role string, text string")
    back = op1_chat.read_back(op1_chat.format_chats(chats.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return op2_bpe.encode_and_digest(table(spark, sf_dir, "documents"), ranks_path(), public_tokenizers.PATTERN)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with the suffix sums for every context limit."""
    hist = op3.histogram(table(spark, sf_dir, "documents"), ranks_path(), public_tokenizers.PATTERN)
    return op3.suffix_sums(hist)


@query("""
select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest,
       case when octet_length(encode(coalesce(html, ''))) >= 1000 and page_id < max(page_id) over (partition by coalesce(html, ''))
            then 'revisit' else 'response' end record_type,
       case when octet_length(encode(coalesce(html, ''))) >= 1000 and page_id < max(page_id) over (partition by coalesce(html, ''))
            then max(page_id) over (partition by coalesce(html, '')) end refers_to
from pages
""")
def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the capture index."""
    pages = table(spark, sf_dir, "pages")
    found = op4_warc.lookup(pages.select("url", "page_id"), op4_warc.archive(pages), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the quality rules for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = op5_quality.rules(docs, op5_quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.round("score", 6).alias("score"))


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = op6_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", op6_simhash.hex16("fp").alias("fingerprint"), "component_id")


@query()
def op7_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op7_toxicity.train(docs, table(spark, sf_dir, "labels"), where=~op7_toxicity.held_out())
    return op7_toxicity.scored(docs, model).select(
        "doc_id", op7_toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= op7_toxicity.THRESHOLD).cast("int").alias("predicted"))


@query(r"""
with dw as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(len(w), 13) size, array_to_string(list_slice(w, i, i + 12), ' ') s
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from bw where len(w) > 0)),
sizes as (select distinct size from win),
pos as (select doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') s
       from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from dw, sizes where len(w) >= size)),
m as (select distinct doc_id, i, pos.size, item_id from pos join win on pos.s = win.s and pos.size = win.size),
hit as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + size)) j from m) group by doc_id),
items as (select doc_id, count(distinct item_id) n_items,
                 sha256(array_to_string(list_sort(list(distinct item_id::varchar)), ',')) items_sha256 from m group by doc_id)
select dw.doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       coalesce(items_sha256, sha256('')) items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
""")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in verbatim benchmark windows, and the contract's verdict."""
    found = op8_decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        op8_decontamination.is_contaminated().alias("contaminated"))


def _secret_sql() -> str:
    """The scan in SQL: gaps and matches by pattern, offsets from running sums, ownership by hash."""
    parts = [f"""select row_id, owner, repository, '{kind}' as kind, {at} as ord, {least} as least, unnest(gaps) as gap, unnest(hits) as hit,
        unnest(vals) as val, unnest(range(1, len(gaps) + 1)) as n from (select row_id, owner, repository,
        string_split_regex(body, '{p}') as gaps, regexp_extract_all(body, '{p}') as hits, regexp_extract_all(body, '{p}', {group}) as vals
        from d where regexp_matches(body, '{p}'))""" for at, (kind, (pattern, group, least)) in enumerate(op9_secrets.KINDS.items())
        for p in [re.sub(r"(?<=[*+])\+", "", pattern).replace("'", "''")]]  # RE2 has no possessive form and needs none
    order = "order by start, ord"
    return f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as body, coalesce(source, '') as owner,
                  concat_ws('/', coalesce(source, ''), coalesce(lang, '')) as repository from documents),
p as ({" union all ".join(parts)}),
q as (select *, sum(length(gap) + coalesce(length(hit), 0)) over (partition by row_id, kind order by n) as fin from p),
v as (select * exclude (val), case when kind = 'key' then regexp_replace(val, '{op9_secrets.KEY_NOISE}', '', 'g') else val end as val from q
      where hit is not null),
c as (select row_id, owner, repository, kind, ord, (fin - length(hit))::bigint as start, fin::bigint as fin, sha256(val) as h,
             kind = 'key' or len(list_distinct(string_split(val, ''))) >= {op9_secrets.MIN_DISTINCT} as random
      from v where length(val) >= least),
o as (select h, count(distinct owner) as n_owners, count(distinct repository) as n_repositories,
             count(distinct owner) > {op9_secrets.MAX_OWNERS} or count(distinct repository) > {op9_secrets.MAX_REPOSITORIES} as example from c group by h),
s as (select c.*, n_owners, n_repositories, example, random and not example as live, kind || ':' || start || ':' || fin as span from c join o using (h)
      where kind in ('assign', 'access', 'hex') or (random and not example)),
g as (select row_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as x,
             coalesce(string_agg(span, ',' {order}) filter (kind in ('assign', 'access', 'hex')), '') as base,
             string_agg(span, ',' {order}) as spans, count(*) filter (live) as live, count(*) filter (example) as example,
             max(n_owners) as n_owners, max(n_repositories) as n_repositories
      from s group by row_id)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(x, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(live, 0)::bigint as n_live,
       coalesce(example, 0)::bigint as n_example, coalesce(n_owners, 0)::bigint as most_owners,
       coalesce(n_repositories, 0)::bigint as most_repositories
from d left join g using (row_id)"""


@query(_secret_sql())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and which of them look live rather than copied."""
    found = op9_secrets.scan(table(spark, sf_dir, "documents"))
    base = op9_secrets.of_kinds(op9_secrets.BASE)
    count = lambda kind: F.size(op9_secrets.of_kinds((kind,))).cast("long")
    flagged = lambda flag: F.size(F.filter("spans", lambda x: x[flag])).cast("long")
    most = lambda count: F.coalesce(F.array_max(F.transform("spans", lambda x: x[count])), F.lit(0))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(op9_secrets.told(base), 256).alias("base_sha256"), op9_secrets.told(F.col("spans")).alias("spans"),
                        flagged("live").alias("n_live"), flagged("example").alias("n_example"),
                        most("n_owners").alias("most_owners"), most("n_repositories").alias("most_repositories"))


@query()
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines compared, lines that go, and the documents that hold their first matches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone, compared = op10.removed_lines(docs)
    by_doc = gone.groupBy("doc_id").agg(
        F.count("*").alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line")), ",").alias("removed_lines"),
        F.sort_array(F.collect_set("match_doc")).alias("matched_docs"))
    sizes = compared.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return (docs.select("doc_id").join(sizes, "doc_id", "left").join(by_doc, "doc_id", "left")
            .select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("removed_lines", F.lit("")).alias("removed_lines"),
                    F.coalesce("matched_docs", F.expr("cast(array() as array<bigint>)")).alias("matched_docs"),
                    F.coalesce(F.size("matched_docs"), F.lit(0)).cast("long").alias("n_links")))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth document (by hash) the words from one on repeat with a period. Others stay as they are."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("*", F.when(F.coalesce(h % 10 == 0, F.lit(False)), words).alias("w"), F.floor(h / 10).alias("g")).select("*", F.size("w").alias("n"))
    a = F.col("g") % F.col("n")
    cut = chosen.select("*", F.when(F.col("n") > 0, a).alias("a")).withColumn(
        "p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document (every tenth with planted ones), the strongest of them, and the text without their repeats."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = op11.periodic_runs(_with_planted_runs(docs)).withColumn("best", op11.strongest())
    told = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(r"""
with d as (select doc_id, coalesce(text, '') as body, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
t as (select *, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
        ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
        ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
        case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 50 then 'plain'
             when h4 % 100 < 80 then 'spm' else 'psm' end as form from t),
p as (select *, array_to_string(list_slice(units, 1, a), '') as pre, array_to_string(list_slice(units, a + 1, b), '') as mid,
        array_to_string(list_slice(units, b + 1, len(units)), '') as suf from c)
select doc_id, len(units)::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars,
  case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then body when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(body) as restored_sha256
from p
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged, and put back together from its output."""
    found = op12.round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _imatch_sql() -> str:
    """I-Match in SQL: slots by MD5, their document frequencies, and the hashes of each text's chosen terms."""
    lo, hi = op13.BAND
    mask = lambda f, bits: ((1 << bits) - 1) << (f * op13.FAMILY_BITS)
    subsets = [f"list_filter(t, lambda x: x & {mask(f, bits)} = 0)" for f in range(op13.REPLICAS) for bits in op13.LEVELS]
    hashed = lambda x: f"substr(md5(array_to_string({x}, ' ')), 1, {op13.DIGITS})"
    n = 1 + len(subsets)
    piece = lambda x: f"substr({x}, i * {op13.DIGITS} + 1, {op13.DIGITS})"
    told = lambda a, b: f"list_filter(range({n}), lambda i: {piece(a)} <> '{op13.EMPTY}' or {piece(b)} <> '{op13.EMPTY}')"
    like = lambda a, b: f"case when {a} = {b} then 1e0 else len(list_filter({told(a, b)}, lambda i: {piece(a)} = {piece(b)}))::double / len({told(a, b)}) end"
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as body from documents),
e as (select *, length(body) as n, coalesce(lead(body) over w, first_value(body) over w) as after, coalesce(lead(k) over w, first_value(k) over w) as after_k
      from d window w as (order by doc_id nulls first, body rows between unbounded preceding and unbounded following)),
f as (select *, left(body, (n - n // 4)::int) || left(after, (n // 4)::int) as edited from e),
x as (select k, 0 as kind, body as s from f union all select k, 1, edited from f),
w as (select k, kind, list_distinct(regexp_extract_all(s, '{op13.TERM}')) as words from x),
t0 as (select k, kind, list_sort(list_transform(words, lambda z: ('0x' || substr(md5(z), 1, 15))::bigint)) as every from w),
u as (select k, kind, unnest(every) as v, unnest(range(len(every))) as pos from t0),
slots as (select v & {op13.SLOTS - 1} as slot, count(distinct k) as df from u where kind = 0 group by 1),
band as (select slot from slots where ln((select count(*) from d)::double / df) between {lo} and {hi}),
c as (select k, kind, list(v order by pos) as kept from u where v & {op13.SLOTS - 1} in (select slot from band) group by k, kind),
g as (select t0.k, t0.kind, case when len(kept) > 0 then kept else every end as t from t0 left join c using (k, kind)),
s as (select k, kind, {hashed('t')} || {' || '.join(hashed(x) for x in subsets)} as fp from g)
select f.doc_id, f.n::bigint as n_chars, sha256(f.edited) as edited_sha256, a.fp as fingerprint, b.fp as edited_fingerprint,
  {like('a.fp', 'b.fp')} as near_edited, {like('a.fp', 'z.fp')} as near_next
from f join s a on a.k = f.k and a.kind = 0 join s b on b.k = f.k and b.kind = 1 join s z on z.k = f.after_k and z.kind = 0
"""


@query(_imatch_sql())
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are to each other and to the next document's."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lexicon = op13.lexicon(docs)
    docs = op13.with_fingerprints(docs, lexicon, {"fingerprint": "text"})
    pairs = with_next(docs.withColumn("n_chars", F.length("text").cast("long")), "doc_id", "text", {"after": F.col("text"), "next_fingerprint": F.col("fingerprint")})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("after", F.lit(1), cut)))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited", "fingerprint", "next_fingerprint")
    found = op13.with_fingerprints(pairs, lexicon, {"edited_fingerprint": "edited"})
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        op13.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                        op13.likeness("fingerprint", "next_fingerprint").alias("near_next"))
