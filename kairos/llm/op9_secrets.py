"""Secret scan with corpus-wide ownership; DataFrame functions only.

Where a pattern matches in a text follows from ``split`` and
``regexp_extract_all``, which walk the same matches: the text is gap, match,
gap, match, ..., so a running sum of lengths gives the offsets. Texts never
leave the scan: only the pieces of documents that hold a match go on.

A candidate is known by the SHA-256 of its value. Candidates are aggregated
by distinct repositories and owners: a value that more than ``MAX_OWNERS``
owners or more than ``MAX_REPOSITORIES`` repositories have is a widely copied
example, another that looks random is owner-specific and live-looking. Spans
of the provider formats (beyond the base kinds) count where they are
live-looking.

A private key is what stands between its BEGIN and END marks: header lines,
then at least ``MIN_KEY`` base64 characters. Its value is those characters
without line ends (escaped or not) and white space, so that one key counts as
one however its lines are ended. Marks without such a body are prose.

Defined cases: null texts are empty; null owners and repositories are one
empty name; rows that repeat a doc_id are scanned each for itself; tables
without matches give zero counts and empty lists; extra columns are not looked
at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairos.llm.common import shared

#: Kind: (pattern, group that is the secret, least code points of that group). Base kinds first, in the order of ties.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    # the secret is the body behind any number of header lines; line ends may be escaped; *+ never gives back, so long texts are safe
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x20\x09\x0A\x0D]|\\[nr])*+(?:[A-Za-z0-9-]+:[^\x0A\\]*(?:[\x20\x09\x0A\x0D]|\\[nr])++)*+"
            r"([A-Za-z0-9+/=\x20\x09\x0A\x0D\\]+)-----END [A-Z ]*PRIVATE KEY-----", 1, 64),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 30),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "cloud": (r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 30),
}
BASE = ("assign", "access", "hex")
#: More distinct owners, or repositories, than this make a value an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: What is not part of a private key's value: line ends, escaped ones, and white space.
KEY_NOISE = r"\\[nr]|[\x20\x09\x0A\x0D\\]"
#: Distinct characters that a live-looking value has at least.
MIN_DISTINCT = 6

_EMPTY = "cast(array() as array<struct<kind:string,n:int,gap:int,len:int,value:string>>)"


def _pieces(text: Column, kind: str) -> Column:
    """Per match of the kind: its number, the code points since the match before, its own, and its secret."""
    pattern, group, least = KINDS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    cut = F.transform(F.slice(rows, 1, F.size(rows) - 1), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"),
        x["value"].alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), cut).otherwise(F.expr(_EMPTY))


def candidates(documents: DataFrame, *, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")
               ) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id; candidates: row, kind, start, end, hash, random, owner, repository)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]
    found = shared(documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", *names).alias("repository"),
        F.concat(*[_pieces(text, kind) for kind in KINDS]).alias("pieces")), "secret-pieces")
    each = found.filter(F.size("pieces") > 0).select("row", "owner", "repository", F.explode("pieces").alias("p"))
    run = Window.partitionBy("row", "p.kind").orderBy("p.n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("p.gap") + F.col("p.len")).over(run))
    least = F.create_map(*[F.lit(x) for kind, (_, _, n) in KINDS.items() for x in (kind, n)])
    value = F.when(F.col("p.kind") == "key", F.regexp_replace("p.value", KEY_NOISE, "")).otherwise(F.col("p.value"))
    each = each.withColumn("secret", value)
    value = F.col("secret")
    distinct = F.size(F.array_distinct(F.split(value, "")))
    each = each.filter(F.length(value) >= least[F.col("p.kind")]).select(
        "row", F.col("p.kind").alias("kind"), (F.col("end") - F.col("p.len")).alias("start"), "end",
        F.sha2(value, 256).alias("hash"), ((distinct >= MIN_DISTINCT) | (F.col("p.kind") == "key")).alias("random"),
        "owner", "repository")
    return found.select("row", "doc_id"), shared(each, "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories and example of every candidate value."""
    places = found.select("hash", "owner", "repository").distinct()
    counts = places.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    return counts.withColumn("example", (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES))


def scan(documents: DataFrame, **columns) -> DataFrame:
    """doc_id and spans: array of start, at, kind, end, n_owners, n_repositories, example and live in order of start and kind, one
    row per input row."""
    rows, found = candidates(documents, **columns)
    owned = shared(ownership(found), "secret-owners")
    order = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (kind, i)])
    live = F.col("random") & ~F.col("example")
    spans = (found.join(owned, "hash").withColumn("live", live).filter(F.col("kind").isin(*BASE) | F.col("live"))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
                 "start", order[F.col("kind")].alias("at"), "kind", "end", "n_owners", "n_repositories", "example", "live"))).alias("spans")))
    none = ("cast(array() as array<struct<start:bigint,at:int,kind:string,end:bigint,n_owners:bigint,n_repositories:bigint,"
            "example:boolean,live:boolean>>)")
    return rows.join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.expr(none)).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kinds(kinds: tuple[str, ...]) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))
