"""Text clean-up and character n-grams as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space when a Unicode string
# is stripped (Java's \s is ASCII only, so the rest is spelled out).
WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

# Characters other than \n and \r that end a line in a text feed.
LINE_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Spellings of a missing URL.
NULL_SPELLINGS = ("", "nan", "None")


def strip_whitespace(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def null_if_blank(text: Column) -> Column:
    """Turn the known spellings of a missing value into NULL."""
    return F.when(~text.isin(*NULL_SPELLINGS), text)


def clean_url(url: Column) -> Column:
    """Stripped URL, or NULL when nothing usable is left."""
    return null_if_blank(strip_whitespace(url))


def binary_label(label: Column) -> Column:
    """``good`` -> 0 and ``bad`` -> 1 in any case or padding; all else NULL."""
    word = F.lower(strip_whitespace(label))
    return F.when(word == "good", 0).when(word == "bad", 1).cast("int")


def drop_invalid_utf8(text: Column) -> Column:
    """Ignore undecodable bytes, keeping the rest of the text."""
    return F.when(
        F.is_valid_utf8(text), text
    ).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def gram_source(text: Column) -> Column:
    """Lower-case, with runs of two or more blanks folded into one space."""
    return F.regexp_replace(F.lower(text), WHITESPACE + "{2,}", " ")


def char_ngrams_sql(text: str, low: int, high: int) -> str:
    """SQL text for all overlapping character n-grams of ``text``.

    A look-ahead match steps through the string once per n.  Cutting grams out
    with ``substring`` would re-scan UTF-8 from the start for each position and
    so cost quadratic time on long texts.
    """
    if not 1 <= low <= high:
        raise ValueError(f"bad n-gram range: {low}..{high}")
    source = f"regexp_replace(lower({text}), r'{WHITESPACE}{{2,}}', ' ')"
    parts = [
        f"regexp_extract_all({source}, r'(?s)(?=(.{{{n}}})).', 1)"
        for n in range(low, high + 1)
    ]
    return f"concat({', '.join(parts)})"


def char_ngrams(text: str, low: int = 2, high: int = 3) -> Column:
    """``ARRAY<STRING>`` of overlapping character n-grams, repeats kept."""
    return F.expr(char_ngrams_sql(text, low, high))
