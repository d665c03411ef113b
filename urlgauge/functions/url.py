"""URL splitting without a UDF.

The splitter follows the usual RFC-3986-like rules of Python's standard
library: tabs and line ends vanish, the authority ends at the first ``/``,
``?`` or ``#``, and a handful of authorities are rejected as malformed.  Spark's
own ``try_parse_url`` is stricter (NULL for blanks, pipes, ...) and cannot be
used for hostile URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.text import strip_whitespace

# Code points whose compatibility normal form contains one of
# / ? # @ : -- a host with one of them is malformed.
UNSAFE_HOST_CHARS = (
    "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16"
    "\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20"
)

INVALID_HOST = "invalid"

_REST = 2**31 - 1  # "to the end" for substring

def _ipv6_pattern() -> str:
    """Regex for an IPv6 literal, built from the group-counting rule."""
    group = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{v4}"]
    for left in range(8):
        head = "" if left == 0 else f"{group}(?::{group}){{{left - 1}}}"
        room = 7 - left
        tails = []
        if room >= 1:
            tails.append(rf"{group}(?::{group}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(rf"(?:{group}:){{0,{room - 2}}}{v4}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        forms.append(f"{head}::{tail}")
    return rf"(?:{'|'.join(forms)})(?:%[^%]+)?"


# What may stand between brackets: an IPv6 literal or the "vX." form.
_BRACKETED_HOST = rf"(?s)^(?:{_ipv6_pattern()}|v[a-fA-F0-9]+\..+)\z"


def drop_line_chars(url: Column) -> Column:
    """Tabs and line ends are ignored anywhere in a URL."""
    for char in "\t\r\n":
        url = F.replace(url, F.lit(char), F.lit(""))
    return url


def ensure_http(url: Column) -> Column:
    """Prefix ``http://`` unless the URL starts (case-sensitively) with a web scheme."""
    absolute = url.startswith("http://") | url.startswith("https://")
    return F.when(absolute, url).otherwise(F.concat(F.lit("http://"), url))


def scheme(url: Column) -> Column:
    """``https`` or ``http``; a URL without a (lower-case) web scheme reads as ``http``."""
    return F.when(url.startswith("https://"), "https").otherwise("http")


def after_scheme(url: Column) -> Column:
    """What follows ``://``, or the whole text of a URL without a web scheme."""
    rest = (
        F.when(url.startswith("http://"), F.substring(url, 8, _REST))
        .when(url.startswith("https://"), F.substring(url, 9, _REST))
        .otherwise(url)
    )
    return drop_line_chars(rest)


def before(text: Column, *marks: str) -> Column:
    """``text`` up to the first of the marks; a byte search, cheaper than a regex."""
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def malformed_authority(netloc: Column) -> Column:
    """True where the standard splitter refuses the authority."""
    opened, closed = netloc.contains("["), netloc.contains("]")
    literal = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    # Only a host with non-ASCII text can hold an unsafe character.
    unsafe = (F.octet_length(netloc) > F.length(netloc)) & netloc.rlike(f"[{UNSAFE_HOST_CHARS}]")
    bad = (opened != closed) | (opened & ~literal.rlike(_BRACKETED_HOST)) | unsafe
    return F.coalesce(bad, F.lit(False))


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``netloc`` and ``path``, lower-cased, as used by the URL features.

    The steps are separate projections on purpose: the optimizer keeps them
    apart because each value is read several times, so every regex runs once
    per row.  A malformed URL reads as host ``invalid`` with an empty path.
    """
    return (
        df.withColumn("_rest", after_scheme(F.col(url)))
        .withColumns({"_host": before(F.col("_rest"), "/", "?", "#"), "_front": before(F.col("_rest"), "?", "#")})
        .withColumn("_bad", malformed_authority(F.col("_host")))
        .withColumns(
            {
                "netloc": F.when(F.col("_bad"), INVALID_HOST).otherwise(F.lower("_host")),
                "path": F.when(F.col("_bad"), "").otherwise(F.lower(_tail("_front", "_host"))),
            }
        )
        .drop("_rest", "_host", "_front", "_bad")
    )


def _tail(text: str, head: str) -> Column:
    """What follows the prefix ``head`` of ``text``."""
    return F.substring(F.col(text), F.length(head) + 1, F.lit(_REST))


def with_split_url(df: DataFrame, url: str, into: str) -> DataFrame:
    """Add ``into``: STRUCT<scheme, netloc, path, query, fragment> in original case.

    NULL where the URL is malformed.
    """
    return (
        df.withColumn("_rest", after_scheme(F.col(url)))
        .withColumns(
            {
                "_host": before(F.col("_rest"), "/", "?", "#"),
                "_front": before(F.col("_rest"), "?", "#"),
                "_main": before(F.col("_rest"), "#"),
            }
        )
        .withColumn(
            into,
            F.when(
                F.col("_rest").isNotNull() & ~malformed_authority(F.col("_host")),
                F.struct(
                    scheme(F.col(url)).alias("scheme"),
                    F.col("_host").alias("netloc"),
                    _tail("_front", "_host").alias("path"),
                    _after_mark("_main", "_front").alias("query"),
                    _after_mark("_rest", "_main").alias("fragment"),
                ),
            ),
        )
        .drop("_rest", "_host", "_front", "_main")
    )


def _after_mark(text: str, head: str) -> Column:
    """What follows the prefix ``head`` of ``text`` and one mark."""
    return F.substring(F.col(text), F.length(head) + 2, F.lit(_REST))


def exploration_domain(url: Column) -> Column:
    """Host as read by the data-exploration report.

    Any text starting with ``http`` counts as absolute here, so ``httpbin.org/x``
    has no host at all; malformed URLs give an empty host.
    """
    absolute = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.regexp_extract(
        drop_line_chars(absolute), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1
    )
    return F.when(malformed_authority(host), "").otherwise(F.lower(host))


def query_param_count(url: Column) -> Column:
    """Number of ``&``-separated pieces after the first ``?`` (0 if blank).

    A fragment counts as part of the query.
    """
    query = F.regexp_extract(url, r"(?s)\?(.*)", 1)
    pieces = F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1
    return F.when(strip_whitespace(query) == "", 0).otherwise(pieces).cast("int")
