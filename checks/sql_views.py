"""The derived tables of :mod:`checks.views` as SQL text."""

from urlgauge.functions.features import KEYWORDS as WORDS

URLS = """
SELECT page_id AS ordinal, url, CASE WHEN url LIKE 'http://%' THEN 1 ELSE 0 END AS label, 'site' AS source
FROM pages"""

URLS_RAW = f"""
SELECT CASE WHEN ordinal % 75 = 0 THEN NULL WHEN ordinal % 75 = 25 THEN '' WHEN ordinal % 75 = 50 THEN 'nan'
            WHEN ordinal % 10 = 3 THEN '  ' || url || ' ' || chr(9) ELSE url END AS url,
       CASE WHEN ordinal % 40 = 7 THEN 'unknown'
            WHEN label = 1 THEN CASE WHEN ordinal % 2 = 0 THEN ' bad ' ELSE 'BAD' END
            ELSE CASE WHEN ordinal % 2 = 0 THEN 'Good' ELSE 'good' END END AS label,
       ordinal
FROM ({URLS})
UNION ALL
SELECT url, CASE WHEN label = 1 THEN 'good' ELSE 'bad' END, ordinal + 1000000000
FROM ({URLS}) WHERE ordinal % 15 = 4"""

CLEAN = f"""
SELECT ordinal, CASE WHEN u IN ('', 'nan', 'None') THEN NULL ELSE u END AS url,
       CASE l WHEN 'good' THEN 0 WHEN 'bad' THEN 1 END AS label
FROM (SELECT ordinal, trim(url, ' ' || chr(9)) AS u, lower(trim(label)) AS l FROM ({URLS_RAW}))"""

LABELLED = f"""
SELECT url, arg_min(label, ordinal) AS label, min(ordinal) AS ordinal
FROM ({CLEAN}) WHERE url IS NOT NULL AND label IS NOT NULL GROUP BY url"""

FEED_RAW = f"""
SELECT CASE WHEN ordinal % 7 = 0 THEN url ELSE url || '/feed' END AS url, ordinal FROM ({URLS})
UNION ALL SELECT url || '/feed', ordinal + 1000000000 FROM ({URLS}) WHERE ordinal % 7 <> 0 AND ordinal % 2 = 0"""

FEED = f"SELECT url, 1 AS label, min(ordinal) AS ordinal, 'feed' AS source FROM ({FEED_RAW}) GROUP BY url"

LINKS = """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos,
       CASE WHEN starts_with(href, 'http') THEN href ELSE site || href END AS url
FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
             unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
             generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos
      FROM pages)"""

SCORED = f"""
SELECT *, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS pred
FROM (SELECT *, round(least(1.0, len(regexp_extract_all(url, '\\p{{Nd}}')) / 12.0::DOUBLE
        + 0.25::DOUBLE * len(regexp_extract_all(url, '\\?')) + 0.2::DOUBLE * label), 2) AS proba FROM ({URLS}))"""

SCORED_ITEMS = """
SELECT l_linestatus AS source, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_extendedprice / 105000.0::DOUBLE AS proba,
       CASE WHEN l_extendedprice / 105000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS pred
FROM lineitem"""


def absolute(url: str) -> str:
    scheme = f"CASE WHEN starts_with({url}, 'http://') OR starts_with({url}, 'https://') THEN {url} ELSE 'http://' || {url} END"
    return f"regexp_replace({scheme}, '[\\t\\r\\n]', '', 'g')"


def parts(source: str, columns: str) -> str:
    """``columns, url, netloc, path`` in lower case; a lone bracket makes a host malformed."""
    return f"""
SELECT {columns}, url, CASE WHEN bad THEN 'invalid' ELSE lower(host) END AS netloc,
       CASE WHEN bad THEN '' ELSE lower(folder) END AS path
FROM (SELECT *, contains(host, '[') <> contains(host, ']') AS bad
      FROM (SELECT *, regexp_extract(a, '^[a-z]+://([^/?#]*)', 1) AS host,
                   regexp_extract(a, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS folder
            FROM (SELECT *, {absolute('url')} AS a FROM ({source}))))"""


def _found(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INTEGER)"


FEATURE_COLUMNS = ", ".join(
    [
        "CAST(length(url) AS INTEGER) AS url_len",
        _found("url", r"\p{Nd}") + " AS num_digits",
        _found("url", "[A-Za-z]") + " AS num_letters",
        _found("url", "/") + " AS num_slash",
        _found("url", r"\.") + " AS num_dot",
        _found("url", "-") + " AS num_dash",
        _found("url", "@") + " AS num_at",
        _found("url", r"\?") + " AS num_qmark",
        _found("url", "=") + " AS num_equal",
        _found("url", "%") + " AS num_percent",
        _found("path", "/") + " AS num_subdirs",
        _found("netloc", r"\.") + " AS num_subdomains",
        r"CAST(regexp_matches(netloc, '^(\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$') AS INTEGER) AS has_ip",
        *[f"CAST(contains(upper(path), '{w.upper()}') AS INTEGER) AS kw_{w}" for w in WORDS],
    ]
)


def features(source: str, columns: str) -> str:
    return f"SELECT {columns}, url, {FEATURE_COLUMNS} FROM ({parts(source, columns)})"


def split(source: str, key: str, label: str, columns: str) -> str:
    """``columns, split`` by the exact hash-ordered rule."""
    return f"""
WITH k AS (SELECT *, md5('42#' || {key}) AS h FROM ({source})),
c AS (SELECT {label} AS lab, count(*) AS n FROM k GROUP BY 1),
t AS (SELECT lab, n, CAST(sum(n) OVER () AS BIGINT) AS total,
             CAST(floor(0.8::DOUBLE * sum(n) OVER ()) AS BIGINT) AS size FROM c),
q AS (SELECT lab, size, (size * n) // total AS base, (size * n) % total AS rest FROM t),
quota AS (SELECT lab, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lab) <= size - sum(base) OVER ()
                             THEN 1 ELSE 0 END AS take FROM q),
r AS (SELECT k.*, row_number() OVER (PARTITION BY {label} ORDER BY h) AS rn FROM k)
SELECT {columns}, CASE WHEN rn <= take THEN 'train' ELSE 'test' END AS split
FROM r JOIN quota ON r.{label} = quota.lab"""


def cells(source: str, by: str = "") -> str:
    """Confusion cells and ranking sums per group; ``by`` is a column list with a comma."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""
SELECT {by} count(*) AS n,
       count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
       count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp
FROM ({source}) {group}"""


def ranking(source: str, by: str = "") -> str:
    """``by, roc_auc, pr_auc``, unrounded."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""
SELECT {by} CASE WHEN sum(p) > 0 AND sum(m) > 0
                 THEN sum(m * (cp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(m)) END AS roc_auc,
       CASE WHEN sum(p) > 0 AND sum(m) > 0 THEN sum(p * cp::DOUBLE / (cp + cm)) / sum(p) END AS pr_auc
FROM (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS cp, CAST(sum(m) OVER w AS BIGINT) AS cm
      FROM (SELECT {by} proba, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS m
            FROM ({source}) GROUP BY {by} proba)
      WINDOW w AS ({part} ORDER BY proba DESC))
{group}"""


RATES = """
round((tp + tn)::DOUBLE / n, 9) AS accuracy,
round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn)
  / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0), 0), 9) AS mcc"""


def metrics(source: str, by: str = "") -> str:
    """``by, n, cells, rates, roc_auc, pr_auc``."""
    key = by.rstrip(", ")
    on = f"USING ({key})" if by else "ON true"
    return f"""
SELECT {by} n, tn, fp, fn, tp, {RATES}, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc
FROM ({cells(source, by)}) JOIN ({ranking(source, by)}) {on}"""


def attacks(source: str, columns: str, label: str, extra: str) -> str:
    """``url_orig, url_adv, attack, columns`` for the four perturbations."""
    tail = "CASE WHEN q = '' THEN '' ELSE '?' || q END || CASE WHEN f = '' THEN '' ELSE '#' || f END"
    tracked = f"'?' || CASE WHEN q = '' THEN '{extra}' ELSE q || '&{extra}' END || CASE WHEN f = '' THEN '' ELSE '#' || f END"
    split_url = f"""
SELECT *, regexp_extract(a, '^([a-z]+)://', 1) AS s, regexp_extract(a, '^[a-z]+://([^/?#]*)', 1) AS h,
       regexp_extract(a, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p,
       regexp_extract(split_part(a, '#', 1), '\\?(.*)', 1, 's') AS q, regexp_extract(a, '#(.*)', 1, 's') AS f
FROM (SELECT *, {absolute('url')} AS a FROM ({source}))"""
    variants = {
        "subdomain": f"s || '://{label}.' || h || p || {tail}",
        "tracking": f"s || '://' || h || p || {tracked}",
        "encode": f"s || '://' || h || replace(url_encode(p), '%2F', '/') || {tail}",
        "homoglyph": "replace(replace(url, 'login', 'Iogin'), 'paypal', 'paypaI')",
    }
    return f"WITH sp AS ({split_url}) " + " UNION ALL ".join(
        f"SELECT url AS url_orig, {text} AS url_adv, '{name}' AS attack, {columns} FROM sp"
        for name, text in variants.items()
    )
