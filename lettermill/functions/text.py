"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters of a Unicode-aware ``\s`` other than the plain space.
_OTHER_WHITESPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"

# Limits of the extractive summary.
SUMMARY_MAX_SENTENCE_CHARS = 240
SUMMARY_MAX_WORDS = 48


def collapse_whitespace(text: Column) -> Column:
    """Every whitespace run becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{_OTHER_WHITESPACE} ]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(~text.rlike(f"[^{_OTHER_WHITESPACE} ]"), F.lit(True))


def word_tokens(text: Column) -> Column:
    """Lower-cased ASCII word tokens with apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), 0)


def split_words(text: Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return F.filter(F.split(collapse_whitespace(text), " "), lambda word: word != "")


def extractive_summary(body: Column) -> Column:
    """First sentence when short enough, else the whole text when it has few words, else its first words.

    Null for blank bodies, which the caller may turn into an error.
    """
    text = collapse_whitespace(body)
    first_sentence = F.split(text, r"(?<=[.!?])\s+", 2)[0]
    words = F.split(text, " ")
    shortened = F.concat(F.array_join(F.slice(words, 1, SUMMARY_MAX_WORDS), " "), F.lit("..."))
    return F.when(
        text != "",
        F.when(F.length(first_sentence) <= SUMMARY_MAX_SENTENCE_CHARS, first_sentence)
        .when(F.size(words) <= SUMMARY_MAX_WORDS, text)
        .otherwise(shortened),
    )


def capitalize(text: Column) -> Column:
    """First character upper case, all others lower case (``initcap`` would change every word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def parse_int(text: Column) -> Column:
    """Integer or null, surrounding blanks allowed."""
    return collapse_whitespace(text).try_cast("bigint")


def parse_int_list(text: Column) -> Column:
    """Whitespace-separated integers; anything else is skipped."""
    # The pattern goes first: a refused cast is far more costly than a refused match.
    numbers = F.filter(F.split(collapse_whitespace(text), " "), lambda word: word.rlike("^[+-]?[0-9]+$"))
    parsed = F.transform(numbers, lambda word: word.try_cast("bigint"))
    return F.coalesce(F.filter(parsed, lambda n: n.isNotNull()), F.array().cast("array<bigint>"))


def nonblank_array(values: Column) -> Column:
    """Array without null and empty members; empty for null."""
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))
