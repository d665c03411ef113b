"""The 22 lexical URL features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.url import with_url_parts

# Words looked for in the path.
KEYWORDS = (
    "login",
    "verify",
    "secure",
    "update",
    "account",
    "bank",
    "paypal",
    "confirm",
    "free",
)

# Characters counted over the whole URL.
COUNTED_CHARS = {
    "num_slash": "/",
    "num_dot": ".",
    "num_dash": "-",
    "num_at": "@",
    "num_qmark": "?",
    "num_equal": "=",
    "num_percent": "%",
}

NUMERIC_FEATURES = (
    "url_len",
    "num_digits",
    "num_letters",
    *COUNTED_CHARS,
    "num_subdirs",
    "num_subdomains",
    "has_ip",
)
KEYWORD_FEATURES = tuple(f"kw_{word}" for word in KEYWORDS)
FEATURES = NUMERIC_FEATURES + KEYWORD_FEATURES

IPV4_HOST = r"^(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}\z"


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one character; a byte-level replace beats a regex count."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_digits(text: Column) -> Column:
    """Unicode decimal digits."""
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{Nd}+", ""))


def count_letters(text: Column) -> Column:
    """ASCII letters."""
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))


def feature_columns(url: str = "url", netloc: str = "netloc", path: str = "path") -> dict[str, Column]:
    """Name -> expression for every feature, given the split host and path."""
    text, host, folder = F.col(url), F.col(netloc), F.col(path)
    # A case-blind match compares upper-cased text: the long s counts as S.
    upper = F.upper(folder)
    columns = {
        "url_len": F.length(text),
        "num_digits": count_digits(text),
        "num_letters": count_letters(text),
        **{name: count_char(text, char) for name, char in COUNTED_CHARS.items()},
        "num_subdirs": count_char(folder, "/"),
        "num_subdomains": count_char(host, "."),
        "has_ip": host.rlike(IPV4_HOST).cast("int"),
    }
    for word in KEYWORDS:
        columns[f"kw_{word}"] = upper.contains(word.upper()).cast("int")
    return columns


def with_url_features(df: DataFrame, url: str = "url") -> DataFrame:
    """All input columns plus the 22 features; one narrow stage, no shuffle."""
    return (
        with_url_parts(df, url)
        .withColumns(feature_columns(url))
        .drop("netloc", "path")
    )


def url_features(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("label", "source")) -> DataFrame:
    """Feature table: the URL, the pass-through columns present, then the features."""
    passed = [name for name in keep if name in df.columns]
    return with_url_features(df, url).select(url, *passed, *FEATURES)
