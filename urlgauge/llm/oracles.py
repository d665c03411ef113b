"""SQL twins of the queries on copies and contamination: plain joins on whole windows and sets."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, pattern: str, lower: bool = True) -> str:
    text = f"coalesce({text}, '')"
    text = f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text
    return f"regexp_extract_all({text}, '{pattern}')"


def runs(n: str) -> str:
    """All runs of n words of the list w, each as one text."""
    return f"list_transform(range(1, len(w) - {n} + 2), lambda x: array_to_string(w[x:x + {n} - 1], ' '))"


SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {words("text", SPACED)} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN {runs("5")} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), r(doc, node) AS (
  SELECT a, b FROM e UNION SELECT r.doc, e.b FROM r JOIN e ON r.node = e.a
), c AS (
  SELECT doc, min(node) AS least FROM r GROUP BY doc
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc = d.doc_id
"""

CONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, {words("text", ALNUM)} AS w FROM documents
), i AS (
  SELECT item_id, {words("text", ALNUM)} AS w FROM benchmark
), k AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest({runs("least(len(w), 10)")}) AS key FROM i WHERE len(w) > 0
), g AS (
  SELECT doc_id, n, {runs("n")} AS keys FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n
), h AS (
  SELECT doc_id, item_id, spot, g.n FROM (SELECT doc_id, n, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS spot FROM g) g JOIN k USING (n, key)
), c AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS place FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

REPEATED_PHRASES = f"""
WITH d AS (
  SELECT doc_id, {words("text", SPACED, lower=False)} AS w FROM documents
), g AS (
  SELECT doc_id, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS spot FROM (SELECT doc_id, {runs("35")} AS keys FROM d WHERE len(w) >= 35)
), again AS (
  SELECT key FROM g GROUP BY key HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(spot, spot + 35)) AS place FROM g JOIN again USING (key)
), t AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d
), kept AS (
  SELECT t.doc_id, count(gone.place) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.place) FILTER (WHERE gone.place IS NULL), '') AS rest
  FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.place = t.place GROUP BY t.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

REPEATED_BYTES = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT doc_id, unnest(keys) AS key, unnest(range(0, len(keys))) AS spot
  FROM (SELECT doc_id, list_transform(range(0, length(h) // 2 - 199), lambda x: md5_number(substr(h, 2 * x + 1, 400))) AS keys FROM d)
), again AS (
  SELECT key FROM g GROUP BY key HAVING count(*) > 1
), s AS (
  SELECT doc_id, spot, spot - lag(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS step FROM g SEMI JOIN again USING (key)
), n AS (
  SELECT doc_id, spot, count(*) FILTER (step IS NULL OR step > 200) OVER (PARTITION BY doc_id ORDER BY spot) AS run FROM s
), r AS (
  SELECT doc_id, run, min(spot) AS first, max(spot) + 200 AS last FROM n GROUP BY doc_id, run
), p AS (
  SELECT r.*, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM r
), k AS (
  SELECT p.doc_id, sum(last - first) AS n_removed, count(*) AS n_spans, max(last) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS rest
  FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(rest, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
