"""Feature and perturbation columns against golden rows and a plain-Python check."""

import random
import re
import unicodedata
from urllib.parse import quote, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from urlgauge.functions.features import FEATURES, KEYWORDS, NUMERIC_FEATURES, url_features
from urlgauge.functions.perturb import TEXT_MODEL_ATTACK, explode_attacks
from urlgauge.functions.text import binary_label, char_ngrams, clean_url
from urlgauge.functions.url import (
    UNSAFE_HOST_CHARS,
    exploration_domain,
    query_param_count,
    with_url_parts,
)

GOLDEN = [
    ("http://www.paypal.com.evil.tk/login/verify?acct=1", "49 1 37 4 4 0 0 1 1 0 2 4 0", "login+verify"),
    ("paypal-secure.com/Account/Update.php", "36 0 31 2 2 1 0 0 0 0 2 1 0", "update+account"),
    ("192.168.0.1/bank", "16 8 4 1 3 0 0 0 0 0 1 3 1", "bank"),
    ("http://192.168.0.1:8080/x", "25 12 5 3 3 0 0 0 0 0 1 3 0", ""),
    ("HTTP://Foo.com/A", "16 0 11 3 1 0 0 0 0 0 3 0 0", ""),
    ("https://a.com", "13 0 9 2 1 0 0 0 0 0 0 1 0", ""),
    ("a.com?u=/login/", "15 0 10 2 1 0 0 1 1 0 0 1 0", ""),
    ("http://user:pw@h.com/free%20gift", "32 2 22 3 1 0 1 0 0 1 1 1 0", "free"),
    ("http://[::1/login", "17 1 9 3 0 0 0 0 0 0 0 0 0", ""),
    ("http://a b.com/x y|z", "20 0 12 3 1 0 0 0 0 0 1 1 0", ""),
    ("http://a.com/\xe4/\U0001f600", "16 0 8 4 1 0 0 0 0 0 2 1 0", ""),
    ("//a.com/x", "9 0 5 3 1 0 0 0 0 0 3 0 0", ""),
    ("http://a.com/x?y=1?z=2&w=3#/free", "32 3 16 4 1 0 0 2 3 0 1 1 0", ""),
    ("1.2.3.4", "7 4 0 0 3 0 0 0 0 0 0 3 1", ""),
    ("http://1.2.3.4\n", "15 4 4 2 3 0 0 0 0 0 0 3 1", ""),
    ("http://٣.com/١", "14 2 7 3 1 0 0 0 0 0 1 1 0", ""),
    ("  x.com/a", "9 0 5 1 1 0 0 0 0 0 1 1 0", ""),
    ("http://a.com/x\ty", "16 0 10 3 1 0 0 0 0 0 1 1 0", ""),
    ("", "0 0 0 0 0 0 0 0 0 0 0 0 0", ""),
    ("http://", "7 0 4 2 0 0 0 0 0 0 0 0 0", ""),
]

GOLDEN_ATTACKS = [
    ("paypal.com/login", "subdomain", "http://secure-check.paypal.com/login"),
    ("paypal.com/login", "tracking", "http://paypal.com/login?utm_source=email&utm_campaign=security_update"),
    ("paypal.com/login", "encode", "http://paypal.com/login"),
    ("paypal.com/login", "homoglyph", "paypaI.com/Iogin"),
    ("http://a.com/x y/%41?q=1#f", "tracking",
     "http://a.com/x y/%41?q=1&utm_source=email&utm_campaign=security_update#f"),
    ("http://a.com/x y/%41?q=1#f", "encode", "http://a.com/x%20y/%2541?q=1#f"),
    ("https://a.com/?", "subdomain", "https://secure-check.a.com/"),
    ("https://a.com/?", "tracking", "https://a.com/?utm_source=email&utm_campaign=security_update"),
    ("https://a.com/?", "homoglyph", "https://a.com/?"),
    ("http://a.com?x=1", "subdomain", "http://secure-check.a.com?x=1"),
    ("http://h.com/ä~*;(", "encode", "http://h.com/%C3%A4~%2A%3B%28"),
    ("http://a.com/Login", "homoglyph", "http://a.com/Login"),
]


def random_urls(count=1500, seed=7):
    """Nasty but reproducible URLs: separators, brackets, blanks, non-ASCII."""
    rng = random.Random(seed)
    pieces = list("/?#@:.-=&%[]+*~;(| \t\n\\ſı") + [
        "http://", "https://", "HTTP://", "http:", "login", "PayPal", "bank", "www.", "a.com",
        "1.2.3.4", "192.168.0.1", "٣", "ä", "\U0001f600", "İ", "[::1]", "[2001:db8::1%e]",
        "[1.2.3.4]", "[v1.x]", "[1:2:3:4:5:6:7::]", "[::1.2.3.4]", "[1::2::3]", "：", "?q=1", "#frag", "Free",
    ]
    made = {"".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(count)}
    made |= {"http://" + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(count)}
    return sorted(made)


def split_or_none(url):
    full = url if url[:7] == "http://" or url[:8] == "https://" else f"http://{url}"
    try:
        return urlsplit(full)
    except ValueError:
        return None


def plain_features(url):
    parts = split_or_none(url)
    host, path = ("invalid", "") if parts is None else (parts.netloc.lower(), parts.path.lower())
    counts = [
        len(url),
        sum(unicodedata.category(c) == "Nd" for c in url),
        sum(c.isascii() and c.isalpha() for c in url),
        *(url.count(c) for c in "/.-@?=%"),
        path.count("/"),
        host.count("."),
        int(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", host) is not None),
    ]
    return counts + [int(word.upper() in path.upper()) for word in KEYWORDS]


def feature_rows(spark, urls):
    rows = url_features(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    return {row["url"]: [row[name] for name in FEATURES] for row in rows}


def test_golden_features(spark):
    got = feature_rows(spark, [url for url, _, _ in GOLDEN])
    for url, counts, words in GOLDEN:
        wanted = [int(n) for n in counts.split()] + [int(w in words.split("+")) for w in KEYWORDS]
        assert got[url] == wanted, url
    assert len(NUMERIC_FEATURES) == 13 and len(FEATURES) == 22


def test_features_match_plain_python(spark):
    urls = random_urls()
    got = feature_rows(spark, urls)
    wrong = [(u, got[u], plain_features(u)) for u in urls if got[u] != plain_features(u)]
    assert not wrong, wrong[:5]


def test_url_parts_match_plain_python(spark):
    urls = random_urls(seed=8)
    rows = with_url_parts(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    for row in rows:
        parts = split_or_none(row["url"])
        wanted = ("invalid", "") if parts is None else (parts.netloc.lower(), parts.path.lower())
        assert (row["netloc"], row["path"]) == wanted, row["url"]


def test_null_url_gives_null_features(spark):
    row = url_features(spark.createDataFrame([(None,)], "url string")).first()
    assert all(value is None for value in row)


def test_unsafe_hosts_are_complete():
    found = {
        chr(c)
        for c in range(128, 0x110000)
        if not 0xD800 <= c <= 0xDFFF and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c)))
    }
    assert found == set(UNSAFE_HOST_CHARS)


def test_exploration_domain(spark):
    def plain(url):
        try:
            return urlsplit(url if url[:4] == "http" else f"http://{url}").netloc.lower()
        except ValueError:
            return ""

    urls = random_urls(seed=9) + ["httpbin.org/x", "https://A.com/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for row in df.select("url", exploration_domain(F.col("url")).alias("domain")).collect():
        assert row["domain"] == plain(row["url"]), row["url"]


@pytest.mark.parametrize(
    "url,wanted",
    [("a.com", 0), ("a.com?", 0), ("a.com? \t", 0), ("a.com?x", 1), ("a?x=1&y=2", 2), ("a?x?y&z#&w", 3)],
)
def test_query_param_count(spark, url, wanted):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(query_param_count(F.col("url"))).first()[0] == wanted


def attacked(spark, urls, text=TEXT_MODEL_ATTACK):
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, label int")
    return {(r["url_orig"], r["attack"]): r["url_adv"] for r in explode_attacks(df, text=text).collect()}


def test_golden_attacks(spark):
    got = attacked(spark, sorted({url for url, _, _ in GOLDEN_ATTACKS}))
    for url, attack, wanted in GOLDEN_ATTACKS:
        assert got[url, attack] == wanted


def test_attacks_match_plain_python(spark):
    urls = random_urls(seed=10)
    got = attacked(spark, urls)
    assert len(got) == 4 * len(urls)
    extra = "utm_source=email&utm_campaign=security_update"
    for url in urls:
        parts = split_or_none(url)
        assert got[url, "homoglyph"] == url.replace("login", "Iogin").replace("paypal", "paypaI")
        if parts is None:
            assert [got[url, a] for a in ("subdomain", "tracking", "encode")] == [None] * 3, url
            continue
        assert got[url, "subdomain"] == urlunsplit(parts._replace(netloc="secure-check." + parts.netloc)), url
        query = "&".join(q for q in (parts.query, extra) if q)
        assert got[url, "tracking"] == urlunsplit(parts._replace(query=query)), url
        assert got[url, "encode"] == urlunsplit(parts._replace(path=quote(parts.path))), url


def test_clean_url_and_label(spark):
    rows = [("  a.com\x1f ", " GOOD\t"), ("nan", "bad"), ("None", "Bad "), ("  ", "ugly"), (None, None)]
    df = spark.createDataFrame(rows, "url string, label string")
    got = df.select(clean_url(F.col("url")), binary_label(F.col("label"))).collect()
    assert [tuple(r) for r in got] == [("a.com", 0), (None, 1), (None, 1), (None, None), (None, None)]


def test_char_ngrams(spark):
    texts = ["abc", "A", "", "a  \tb", "x\ny", "\U0001f600ab", "aaa"]
    df = spark.createDataFrame([(t,) for t in texts], "url string")
    got = {r["url"]: r["grams"] for r in df.select("url", char_ngrams("url").alias("grams")).collect()}
    for text in texts:
        folded = re.sub(r"\s\s+", " ", text.lower())
        wanted = [folded[i : i + n] for n in (2, 3) for i in range(len(folded) - n + 1)]
        assert got[text] == wanted
