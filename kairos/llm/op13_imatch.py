"""Document fingerprints: I-Match over randomised lexicon subsets; DataFrame functions only.

1. **Lexicon.** Every document's distinct terms (words) are
   hashed to ``SLOTS`` slots; how many documents hold each slot is counted over
   the whole corpus (partial counts a task, then one row per slot). A slot is
   in the lexicon if its inverse document frequency ln(N / n) lies in a band:
   words of the language and one-off strings say little about a text. The
   lexicon is a bitmap of a fixed size (128 KB), whatever the corpus.
2. **Subsets.** The lexicon has ``REPLICAS`` random families of nested subsets:
   a term is in the subsets of a family up to the number of zero bits that its
   hash begins with there. Sparse subsets survive edits of long texts, dense
   ones tell short texts apart.
3. **Fingerprint.** The distinct terms of a text that are in the lexicon, sorted
   (by their 60-bit hashes), are hashed once as a whole and once per subset. Two texts are alike in the
   share of subsets, of those where one of them has a term, whose hashes agree.

Terms in one slot share its count. Hashing needs no shuffle of documents or of
(document, term) rows: only slot counts move.

Defined cases: null texts are empty; a text without terms has the hash of nothing
everywhere and is like another such text only; a text of which no term is in
the lexicon is hashed over all of its terms; equal texts have equal
fingerprints; repeated rows count and are hashed each for itself; an empty
table has an empty lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import shared, unused

#: Slots of hashed terms; 64 to a word of the bitmap.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Inverse document frequency, natural logarithm: from slots of about 1 in 20 documents to those of 1 in 160,000.
BAND = (3.0, 12.0)
#: Families of subsets, and the zero bits that a term's hash has at least in each subset of a family.
REPLICAS, LEVELS = 6, (2, 4, 6, 7, 8, 9, 10)
#: Bits of a term's hash that a family looks at; all of them fit into 60.
FAMILY_BITS = 10
#: Hex digits of one hash.
DIGITS = 8
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hash of no terms at all: the first digits of the MD5 of nothing.
EMPTY = "d41d8cd9"


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TERM), F.lit(0)))


def _md5(word: Column) -> Column:
    return F.md5(word.cast("binary"))


def terms(text: Column) -> Column:
    """Distinct terms of a text as 60-bit numbers from their MD5."""
    return F.transform(_words(text), lambda w: F.conv(F.substring(_md5(w), 1, 15), 16, 10).cast("long"))


def _slot(term: Column) -> Column:
    return term.bitwiseAND(F.lit(SLOTS - 1))


def lexicon(documents: DataFrame, *, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row: ``bitmap``, 64 slots to a number, of the slots whose inverse document frequency is in the band."""
    # a slot is the end of a term's 60 bits: five hex digits, counted as they are
    held = documents.select(F.explode(F.array_distinct(F.transform(_words(F.col(text)), lambda w: F.substring(_md5(w), 11, 5)))).alias("hex"))
    found = held.groupBy("hex").agg(F.count("*").alias("n")).select(F.conv("hex", 16, 10).cast("long").alias("slot"), "n")
    found = shared(found, "imatch-slots")
    total = documents.agg(F.count("*").alias("n")).scalar()
    idf = F.log(total / F.col("n"))
    part = found.filter((idf >= band[0]) & (idf <= band[1])).groupBy(F.shiftright("slot", 6).alias("k")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    every = documents.sparkSession.range(SLOTS >> 6).select(F.col("id").alias("k"))  # the bitmap's words, a fixed number
    words = every.join(part, "k", "left").select("k", F.coalesce("bits", F.lit(0)).alias("bits"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("k", "bits"))), lambda x: x["bits"])
    return shared(words.agg(packed.alias("bitmap")), "imatch-lexicon")


def _in(bitmap: str, term: Column) -> Column:
    return F.getbit(F.get(F.col(bitmap), F.shiftright(_slot(term), 6).cast("int")), _slot(term).bitwiseAND(63).cast("int")) == 1


def _hashed(some: Column) -> Column:
    """Hash of a list of terms; ``EMPTY`` for an empty one."""
    return F.substring(F.md5(F.array_join(F.transform(some, lambda t: t.cast("string")), " ").cast("binary")), 1, DIGITS)


def _subset(some: str, family: int, bits: int) -> Column:
    """Those of a list of terms whose hash has at least so many zero bits where the family looks."""
    mask = F.lit(((1 << bits) - 1) << (family * FAMILY_BITS)).cast("long")
    return F.filter(some, lambda t: t.bitwiseAND(mask) == 0)


def with_fingerprints(df: DataFrame, lexicon_: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint column for each text column: the hash of all chosen terms, then those of each family's subsets.

    Columns that have the name of an output are replaced.
    """
    bitmap = lexicon_.select("bitmap").scalar()
    for out, text in texts.items():
        keep = [F.col(f"`{c}`") for c in df.columns if c != out]
        every, known, bits_ = (unused(df, c) for c in ("terms", "known", "bitmap"))
        family = [unused(df, f"family{f}") for f in range(REPLICAS)]
        df = df.select(*keep, terms(F.col(f"`{text}`")).alias(every))
        # a subquery cannot stand inside a lambda: the bitmap is a column until the terms are filtered
        df = df.select(*keep, every, bitmap.alias(bits_)).select(*keep, every, F.filter(every, lambda t: _in(bits_, t)).alias(known))
        df = df.select(*keep, F.sort_array(F.when(F.size(known) > 0, F.col(known)).otherwise(F.col(every))).alias(every))
        # the densest subset of each family first: the sparser ones lie in it
        df = df.select(*keep, every, *[_subset(every, f, LEVELS[0]).alias(family[f]) for f in range(REPLICAS)])
        subsets = [_hashed(_subset(family[f], f, bits) if bits > LEVELS[0] else F.col(family[f])) for f in range(REPLICAS) for bits in LEVELS]
        df = df.select(*keep, F.concat(_hashed(F.col(every)), *subsets).alias(out))
    return df


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the subsets with a term of either text whose hashes agree; 1 where neither text has a term at all."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    n = 1 + REPLICAS * len(LEVELS)
    piece = lambda x, i: F.substr(x, i * DIGITS + 1, F.lit(DIGITS))
    told = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (piece(a, i) != EMPTY) | (piece(b, i) != EMPTY))
    same = F.size(F.filter(told, lambda i: piece(a, i) == piece(b, i)))
    return F.when(a == b, F.lit(1.0)).otherwise(same / F.size(told))


def fingerprints(documents: DataFrame, *, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id and fingerprint (hex digits of the whole and of each subset) of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_fingerprints(docs, lexicon(docs, band=band), {"fingerprint": "text"}).select("doc_id", "fingerprint")
