"""Text column expressions (B20, G3, G4, G6, tokenisation) - all JVM-side regex/array built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens: maximal runs of two or more letters / digits / underscore, after lower-casing
# (the 2+ word-character rule of the reference's vectoriser, written with explicit
# Unicode classes so that every regex engine reads it the same way).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Number words of the digit-to-word rule (S11), in rule order.
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TENS_WORDS = ["ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
HUNDRED_WORD = "onehundred"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text) -> Column:
    """Number of spaces minus one."""
    t = _c(text)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - F.lit(1)


def quote_regex(c) -> Column:
    """Literal-quote a string for a Java pattern (``\\Q..\\E``, with inner ``\\E`` escaped)."""
    return F.concat(F.lit(r"\Q"), F.replace(_c(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def remove_names(text, *names) -> Column:
    """Delete every case-insensitive occurrence of the row's own names.

    The names are quoted (no regex meaning) and null or empty names are
    skipped, so they never match everything. No word boundary, as the
    reference: removing ``ann`` also cuts ``annual``.
    """
    parts = F.filter(F.array(*[_c(n) for n in names]), lambda x: x.isNotNull() & (F.length(x) > 0))
    pat = F.array_join(F.transform(parts, quote_regex), "|")
    return F.when(F.size(parts) > 0, F.regexp_replace(_c(text), F.concat(F.lit("(?i)"), pat), F.lit(""))) \
        .otherwise(_c(text))


def numbers_to_words(text) -> Column:
    """Number-to-word normalisation.

    Decimals are dropped, commas between digits removed, then digit runs with
    a non-digit on both sides become words: one digit -> its word, two digits
    -> the tens word of the first (``15`` -> ``ten``), three digits starting
    with 1 -> ``onehundred``; every other digit is deleted. A run touching the
    start or end of the text is only deleted (the reference's look-arounds
    need a neighbour on both sides).

    Evaluated as one split into digit / non-digit runs and one array
    transform (instead of twenty look-around passes); texts without digits
    pass through untouched.
    """
    t = F.regexp_replace(_c(text), r"\.[0-9]+", "")
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9])", "")
    runs = F.regexp_extract_all(t, F.lit(r"[0-9]+|[^0-9]+"), 0)
    words = F.array(*[F.lit(w) for w in DIGIT_WORDS])
    tens = F.array(*[F.lit(w) for w in TENS_WORDS])

    def conv(x, i, n):
        d0 = F.substring(x, 1, 1)
        is_digits = d0.rlike("^[0-9]$")
        inner = (i > 0) & (i < n - 1)
        mapped = (F.when(F.length(x) == 1, F.element_at(words, d0.cast("int") + 1))
                  .when((F.length(x) == 2) & (d0 != "0"), F.element_at(tens, d0.cast("int")))
                  .when((F.length(x) == 3) & (d0 == "1"), F.lit(HUNDRED_WORD))
                  .otherwise(F.lit("")))
        return F.when(~is_digits, x).when(inner, mapped).otherwise(F.lit(""))

    # the runs are the one element of an outer array, so the regular expressions above run once per text
    # and not once per run (a lambda's free variables are evaluated for every element)
    joined = F.transform(F.array(runs), lambda rs: F.array_join(F.transform(rs, lambda x, i: conv(x, i, F.size(rs))), ""))
    return F.when(t.rlike("[0-9]"), joined[0]).otherwise(t)


def tokens(text) -> Column:
    """Lower-cased tokens in order (array<string>)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def ngrams_1_2(toks: str) -> Column:
    """Unigrams followed by the bigrams ``'a b'`` of consecutive tokens.

    ``toks`` must name a materialised array column: it is referenced twice
    and must not be a regex expression re-evaluated per element.
    """
    t = F.col(toks)
    n = F.size(t)
    bi = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(1))), F.slice(t, 2, F.greatest(n - 1, F.lit(1))),
                    lambda a, b: F.concat(a, F.lit(" "), b))
    bi = F.when(n >= 2, bi).otherwise(F.array().cast("array<string>"))
    return F.concat(t, bi)


def signed_terms(s) -> Column:
    """Split a signed feature string into ``+term`` / ``-term`` pieces.

    Splits at every ``+`` or ``-`` (also inside names) and keeps the sign;
    pieces are trimmed and empty ones dropped.
    """
    raw = F.regexp_extract_all(_c(s), F.lit(r"[+-][^+-]*"), 0)
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def unsigned_terms(s) -> Column:
    """B20 variant: split at ``' +'`` / ``' -'`` and drop the signs and empty pieces."""
    parts = F.split(_c(s), r" \+| -")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
