"""What each query of :mod:`checks.queries` must return, as DuckDB SQL."""

from __future__ import annotations

import json

from checks.sql_views import (
    CLEAN,
    FEATURE_COLUMNS,
    FEED,
    FEED_RAW,
    LABELLED,
    LINKS,
    SCORED,
    SCORED_ITEMS,
    URLS,
    URLS_RAW,
    WORDS,
    attacks,
    cells,
    features,
    metrics,
    parts,
    ranking,
    split,
)

FEATURE_NAMES = [item.rsplit(" AS ", 1)[1] for item in FEATURE_COLUMNS.split(", ") if " AS " in item]
FEATURE_NAMES = [name for name in FEATURE_NAMES if name.startswith(("url_len", "num_", "has_ip"))] + [
    f"kw_{word}" for word in WORDS
]

ERROR_TYPE = (
    "CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 0 AND pred = 0 THEN 'TN' "
    "WHEN label = 0 AND pred = 1 THEN 'FP' ELSE 'FN' END"
)
N_PARAMS = (
    "CASE WHEN NOT contains(url, '?') OR trim(substr(url, instr(url, '?') + 1)) = '' THEN 0 "
    "ELSE CAST(len(regexp_extract_all(substr(url, instr(url, '?') + 1), '&')) + 1 AS INTEGER) END"
)
DOMAIN = (
    "lower(regexp_extract(CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://' || url END, "
    "'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
)
NOISY = f"""
SELECT * REPLACE (CAST(((url_len > 41) <> (num_slash > 4)) <> starts_with(md5(url), '0') AS INTEGER) AS label)
FROM ({features(f"SELECT DISTINCT url, 0 AS label FROM ({LINKS})", "label")})"""
NOISY_SPLIT = split(NOISY, "url", "label", "url, label")
SPLIT_URLS = split(URLS, "url", "label", "url, label")
LABELLED_SITE = f"SELECT *, 'site' AS source FROM ({LABELLED})"
NEW_FEED = f"SELECT * FROM ({FEED}) WHERE url NOT IN (SELECT url FROM ({LABELLED}))"


def describe(source: str, column: str, by: str, digits: int, quartile_digits: int | None = None) -> str:
    def quartile(q):
        value = f"quantile_cont({column}::DOUBLE, {q})"
        return value if quartile_digits is None else f"round({value}, {quartile_digits})"

    return f"""
SELECT {by}, count({column}) AS count, round(avg({column}), {digits}) AS mean,
       round(stddev_samp({column}), {digits}) AS std, min({column})::DOUBLE AS min,
       {quartile(0.25)} AS p25, {quartile(0.5)} AS p50, {quartile(0.75)} AS p75, max({column})::DOUBLE AS max
FROM ({source}) GROUP BY {by}"""


def root_cut(penalty: float, least_rows: int, least_curvature: float) -> str:
    """The cut of the highest second-order gain at the root, ties to the first feature and the lowest cut."""
    part = lambda g, h: f"{g} * {g} / ({h} + {penalty})"
    each = " UNION ALL ".join(f"SELECT {i} AS nth, '{name}' AS feature, {name}::DOUBLE AS x, label FROM t" for i, name in enumerate(FEATURE_NAMES))
    return f"""
WITH t AS ({NOISY}), m AS (SELECT avg(label) AS p, count(*) AS n FROM t),
v AS (SELECT nth, feature, x, count(*) AS n, sum(label) AS ones FROM ({each}) GROUP BY nth, feature, x),
c AS (SELECT nth, feature, x, sum(n) OVER w AS l, sum(ones) OVER w AS lo FROM v WINDOW w AS (PARTITION BY nth ORDER BY x)),
s AS (SELECT nth, feature, x, l, l * p - lo AS lg, l * p * (1 - p) AS lh, (m.n - l) AS r, (m.n - l) * p * (1 - p) AS rh FROM c, m WHERE l < m.n),
g AS (SELECT *, {part("lg", "lh")} + {part("lg", "rh")} AS gain FROM s
      WHERE least(l, r) >= {least_rows} AND least(lh, rh) >= {least_curvature})
SELECT feature, x AS cut, round(gain, 4) AS gain FROM g ORDER BY round(gain, 9) DESC, nth, x LIMIT 1"""


def histogram(source: str, column: str) -> str:
    return f"""
WITH v AS (SELECT {column}::DOUBLE AS x FROM ({source}) WHERE {column} IS NOT NULL),
e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 50 AS w FROM v),
b AS (SELECT CAST(range AS INTEGER) AS bin, lo + range * w AS low,
             CASE WHEN range = 49 THEN hi ELSE lo + (range + 1) * w END AS high FROM range(50), e)
SELECT bin, round(low, 9) AS low, round(high, 9) AS high, count(x) AS count
FROM b LEFT JOIN v ON x >= low AND (x < high OR (bin = 49 AND x <= high)) GROUP BY ALL"""


def grams(source: str, key: str, text: str) -> str:
    """``key, pos, gram``, twos before threes."""
    folded = f"regexp_replace(lower({text}), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]{{2,}}', ' ', 'g')"
    chars = f"SELECT {key}, regexp_extract_all({folded}, '(?s).') AS c FROM ({source})"
    return f"""
SELECT {key}, CAST(pos AS INTEGER) AS pos, gram FROM (
  SELECT {key}, i - 1 AS pos, c[i] || c[i + 1] AS gram
  FROM ({chars}), unnest(range(1, len(c))) AS u(i)
  UNION ALL
  SELECT {key}, greatest(len(c) - 1, 0) + i - 1, c[i] || c[i + 1] || c[i + 2]
  FROM ({chars}), unnest(range(1, len(c) - 1)) AS u(i))"""


def document_frequency(source: str, key: str, text: str) -> str:
    return f"""
SELECT gram, count(DISTINCT {key}) AS df FROM ({grams(source, key, text)}) GROUP BY gram
HAVING count(DISTINCT {key}) >= 2"""


SHORT = "1 - length({0}) / 100.0::DOUBLE"
DETECTED = f"SELECT url, label, ordinal FROM ({URLS}) WHERE label = 1 AND {SHORT.format('url')} >= 0.5"
MAIL = ("secure-check", "utm_source=email&utm_campaign=security_update")
ATTACKED = f"SELECT *, {SHORT.format('url_adv')} AS proba FROM ({attacks(DETECTED, 'label, ordinal', *MAIL)})"


def rule_metrics(cut: float) -> str:
    source = f"SELECT label, proba, CAST(proba >= {cut} AS INTEGER) AS pred FROM ({SCORED})"
    return metrics(source)


SIZES = f"""
SELECT count(*) FILTER (ordinal % 5 <> 0) AS n_train, count(*) FILTER (ordinal % 5 = 0) AS n_test,
       round(avg(label) FILTER (ordinal % 5 <> 0), 9) AS pos_rate_train,
       round(avg(label) FILTER (ordinal % 5 = 0), 9) AS pos_rate_test FROM ({URLS})"""
VALUES = "accuracy, precision, recall, f1, mcc, roc_auc, pr_auc"


def summary_row(model: str, file: str, cut: float, device: str = "NULL", folder: str = "NULL") -> str:
    return f"""
SELECT '{model}' AS model, '{file}' AS source_file, n_train, n_test, pos_rate_train, pos_rate_test,
       {device}::VARCHAR AS device, {folder}::VARCHAR AS bert_dir, {VALUES}
FROM ({rule_metrics(cut)}), ({SIZES})"""


SUMMARY = " UNION ALL ".join(
    [
        *[summary_row(f"rule_{cut}", "ml_results.json", cut) for cut in (0.3, 0.5, 2.0)],
        summary_row("CharTFIDF(2-3)+LogReg", "ngram_results.json", 0.4),
        summary_row("stack", "hybrid_results.json", 0.7, "'cpu'", "'run_1'"),
        f"""
SELECT 'DistilBERT', 'bert_results.json', NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE,
       NULL::VARCHAR, NULL::VARCHAR, accuracy, NULL::DOUBLE, NULL::DOUBLE, f1, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
FROM ({rule_metrics(0.6)})""",
    ]
)


def compared(*rows: tuple[str, float]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model, accuracy, f1, roc_auc, pr_auc FROM ({rule_metrics(cut)})" for model, cut in rows
    )


def _cell(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '' ELSE printf('%.4f', {name}) END"


QUERY_URLS = f"SELECT ordinal, url, source, CAST(contains(url, '?') AS INTEGER) AS label FROM ({URLS})"
QUERY_SPLIT = split(QUERY_URLS, "url", "label", "url, label")
# A model that has learnt the label gets every test row right.
LEARNT = f"""
SELECT count(*) AS n, count(*) FILTER (label = 0) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn,
       count(*) FILTER (label = 1) AS tp, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall,
       1.0::DOUBLE AS f1, 1.0::DOUBLE AS mcc, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS pr_auc
FROM ({QUERY_SPLIT}) WHERE split = 'test'"""


ORACLES: dict[str, str] = {
    "url_features_table": features(URLS, "label, source"),
    "url_parts": parts(URLS, "ordinal"),
    "link_features": features(LINKS, "page_id, pos"),
    "url_with_scheme": r"""
SELECT ordinal, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'http://' || u END AS absolute
FROM (SELECT page_id AS ordinal,
             CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS u FROM pages)""",
    "url_domain_explore": f"SELECT url, {DOMAIN} AS domain FROM pages",
    "url_num_params": f"SELECT url, {N_PARAMS} AS n_params FROM pages",
    "clean_urls": CLEAN,
    "map_labels": f"""
SELECT label AS spelling, CASE lower(trim(label)) WHEN 'good' THEN 0 WHEN 'bad' THEN 1 END AS label, count(*) AS n
FROM ({URLS_RAW}) GROUP BY ALL""",
    **dict.fromkeys(("audit_counts", "audit_observed"), f"""
WITH c AS (SELECT count(*) AS a, count(url) AS b, count(*) FILTER (url IS NOT NULL AND label IS NOT NULL) AS c,
                  count(DISTINCT url) FILTER (label IS NOT NULL) AS d FROM ({CLEAN}))
SELECT 'url_filter' AS stage, a AS rows_before, b AS rows_after, a - b AS removed FROM c
UNION ALL SELECT 'label_filter', b, c, b - c FROM c
UNION ALL SELECT 'dedup', c, d, c - d FROM c"""),
    "dedup_keep_first_url": LABELLED_SITE,
    "dedup_keep_first_doc": """
SELECT doc_id, lang, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "dedup_keep_first_link": f"""
SELECT page_id, pos, url FROM ({LINKS})
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos) = 1""",
    "feed_table": FEED,
    "labelled_csv_scan": f"SELECT url, label, source FROM ({LABELLED_SITE})",
    "text_feed_scan": f"SELECT url, label, source FROM ({FEED})",
    "split_scan": f"SELECT url, label, 'site' AS source FROM ({SPLIT_URLS}) WHERE split = 'test'",
    "table_preview": f"SELECT *, count(*) OVER () AS row_count FROM ({URLS}) ORDER BY ordinal LIMIT 5",
    "required_columns": " UNION ALL ".join(
        f"SELECT '{name}' AS column, count({name}) AS n FROM ({features(URLS, 'label, source')})"
        for name in ["url", "label", "source", *FEATURE_NAMES]
    ),
    "error_slices": f"SELECT url, label, pred, proba FROM ({SCORED}) WHERE label = 0 AND pred = 1",
    "latest_run": """
SELECT event_type, max(run_id) AS run_id, 'models/' || event_type || '/' || max(run_id) AS path
FROM (SELECT event_type, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events WHERE value >= 5)
GROUP BY event_type""",
    "feed_anti_join": NEW_FEED,
    "feed_anti_join_filtered": NEW_FEED,
    "stored_feed_new": NEW_FEED,
    "overlap": f"SELECT count(DISTINCT url) AS overlap FROM ({URLS}) WHERE url IN (SELECT url FROM ({FEED_RAW}))",
    "stored_common_urls": f"SELECT url FROM ({URLS}) INTERSECT SELECT url FROM ({FEED_RAW})",
    "common_url_set": f"SELECT url FROM ({URLS}) INTERSECT SELECT url FROM ({FEED_RAW})",
    **dict.fromkeys(("test_union", "stored_union"), f"""
SELECT url, label, ordinal, source FROM (
  SELECT url, label, ordinal, source, 0 AS side FROM ({URLS})
  UNION ALL SELECT url, label, ordinal, source, 1 FROM ({FEED}))
QUALIFY row_number() OVER (PARTITION BY url ORDER BY side, ordinal) = 1"""),
    "stratified_split_urls": SPLIT_URLS,
    "stratified_split_docs": split("SELECT * FROM labels", "doc_id", "toxic", "doc_id, quality, toxic"),
    "stratified_split_items": f"""
SELECT o_orderkey, o_orderstatus
FROM ({split("SELECT * FROM orders", "o_orderkey", "o_orderstatus", "o_orderkey, o_orderstatus")})
WHERE split = 'train'""",
    "split_class_share": f"""
SELECT split, label, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 9) AS share
FROM ({SPLIT_URLS}) GROUP BY split, label""",
    "exact_sample_urls": f"SELECT url, label FROM ({URLS}) ORDER BY md5('42#' || url) LIMIT 40",
    "exact_sample_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42#' || o_orderkey) LIMIT 2000",
    "full_split": f"""
SELECT url, label, source, split FROM ({split(LABELLED_SITE, "url", "label", "url, label, source")})
UNION ALL SELECT url, label, source, 'test' FROM ({NEW_FEED})""",
    "full_split_audit": f"""
WITH h AS (SELECT count(*) AS n FROM ({split(LABELLED_SITE, "url", "label", "url")}) WHERE split = 'test'),
f AS (SELECT count(*) AS n FROM ({FEED_RAW})),
w AS (SELECT count(*) AS n, count(DISTINCT url) AS d FROM ({FEED_RAW}) WHERE url NOT IN (SELECT url FROM ({LABELLED_SITE})))
SELECT 'feed_overlap' AS stage, f.n AS rows_before, w.n AS rows_after, f.n - w.n AS removed FROM f, w
UNION ALL SELECT 'test_dedup', w.n + h.n, w.d + h.n, w.n - w.d FROM h, w""",
    "label_counts": f"SELECT label, count(*) AS count FROM ({URLS_RAW}) WHERE label IS NOT NULL GROUP BY label",
    "positive_rates": f"""
SELECT source, count(*) AS n, round(avg(label), 9) AS positive_rate FROM ({SCORED_ITEMS}) GROUP BY source""",
    "describe_len": describe(f"SELECT page_id % 2 AS part, length(url) AS url_len FROM ({LINKS})", "url_len", "part", 9),
    "describe_price": describe("SELECT * FROM lineitem", "l_extendedprice", "l_linestatus", 5, 5),
    "describe_features": " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, round(avg({name}), 9) AS mean, round(stddev_samp({name}), 9) AS std,
       min({name})::DOUBLE AS min, max({name})::DOUBLE AS max FROM ({features(URLS, 'label, source')})"""
        for name in FEATURE_NAMES
    ),
    "len_histogram": histogram(f"SELECT length(url) AS url_len FROM ({LINKS})", "url_len"),
    "value_histogram": histogram("SELECT value FROM events", "value"),
    "top_domains": f"""
SELECT {DOMAIN} AS domain, count(*) AS count FROM ({LINKS}) GROUP BY 1 ORDER BY count DESC, domain LIMIT 20""",
    "confusion": f"SELECT tn, fp, fn, tp, concat_ws(',', tn, fp, fn, tp) AS row_major FROM ({cells(SCORED)})",
    "class_metrics": f"""
SELECT n, tn, fp, fn, tp, accuracy, precision, recall, f1, mcc FROM ({metrics(SCORED)})""",
    "ranking_metrics": f"SELECT round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM ({ranking(SCORED)})",
    "metrics_by_source": metrics(SCORED_ITEMS, "source, "),
    "metrics_bucketed": metrics(SCORED_ITEMS, "source, "),
    "single_class_guard": metrics(
        f"SELECT *, CASE WHEN ordinal % 2 = 0 THEN label ELSE 2 END AS grp FROM ({SCORED})", "grp, "
    ),
    "error_types": f"SELECT {ERROR_TYPE} AS error_type, count(*) AS count FROM ({SCORED}) GROUP BY 1",
    "error_profiles": f"""
SELECT error_type, round_even(avg(length(url)), 2) AS avg_url_len, round_even(avg(digits), 2) AS avg_n_digits,
       round_even(avg(params), 2) AS avg_n_params
FROM (SELECT url, {ERROR_TYPE} AS error_type, len(regexp_extract_all(url, '\\p{{Nd}}')) AS digits,
             {N_PARAMS} AS params FROM ({SCORED})) GROUP BY error_type""",
    "top_fp": f"""
SELECT url, label, pred, proba, source FROM ({SCORED}) WHERE label = 0 AND pred = 1
ORDER BY proba DESC, url LIMIT 15""",
    "top_fn": f"""
SELECT url, label, pred, proba, source FROM ({SCORED}) WHERE label = 1 AND pred = 0
ORDER BY proba, url LIMIT 15""",
    "attacks_long": attacks(URLS, "ordinal", *MAIL),
    "attacks_links": attacks(LINKS, "page_id, pos", "sec-check", "utm_source=mail&utm_campaign=security"),
    "attack_by_name": f"""
SELECT l.page_id, l.pos, coalesce(a.attack, 'unknown') AS attack, coalesce(a.url_adv, l.url) AS url_adv
FROM ({LINKS}) AS l LEFT JOIN ({attacks(LINKS, 'page_id, pos', *MAIL)}) AS a
  ON l.page_id = a.page_id AND l.pos = a.pos
 AND a.attack = list_extract(['subdomain', 'tracking', 'encode', 'homoglyph'], 1 + l.page_id % 5)""",
    "attack_success": f"""
SELECT a AS attack, count(url_orig) AS n_total, count(url_orig) FILTER (proba < 0.5) AS n_missed,
       round(coalesce(count(url_orig) FILTER (proba < 0.5) / nullif(count(url_orig), 0)::DOUBLE, 0), 9) AS adv_success_rate
FROM unnest(['subdomain', 'tracking', 'encode', 'homoglyph']) AS t(a) LEFT JOIN ({ATTACKED}) ON attack = a GROUP BY a""",
    "attack_examples": f"""
SELECT attack, url_orig, url_adv, proba, CAST(rn AS INTEGER) AS example
FROM (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY ordinal) AS rn FROM ({ATTACKED}) WHERE proba < 0.5)
WHERE rn <= 5""",
    "char_gram_lists": grams(URLS, "ordinal", "url"),
    "ngram_df": document_frequency(URLS, "ordinal", "url"),
    "ngram_df_docs": document_frequency("SELECT * FROM documents", "doc_id", "text"),
    "ngram_counts_docs": f"""
SELECT doc_id, count(*) AS grams, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS top
FROM (SELECT doc_id, gram, count(*) AS tf FROM ({grams("SELECT * FROM documents", "doc_id", "text")}) GROUP BY ALL)
GROUP BY doc_id""",
    "tfidf_rows": f"""
WITH tf AS (SELECT ordinal, gram, count(*) AS tf FROM ({grams(URLS, "ordinal", "url")}) GROUP BY ALL),
d AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2),
w AS (SELECT ordinal, gram, tf, df, tf * (ln(((SELECT count(*) FROM pages) + 1) / (df + 1)::DOUBLE) + 1) AS w
      FROM tf JOIN d USING (gram))
SELECT ordinal, gram, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY ordinal)), 9) AS tfidf FROM w""",
    "class_weights": f"""
SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 9) AS weight
FROM ({URLS}) GROUP BY label""",
    "safe_numbers": """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN user_id::DOUBLE END AS number FROM events""",
    "meta_fallback": """
SELECT event_id, coalesce(nullif(event_id % 3, 0), nullif(CASE WHEN event_id % 7 <> 0 THEN user_id % 2 END, 0),
                          CASE WHEN event_id % 11 <> 0 THEN event_id % 4 END) AS n_train FROM events""",
    "results_summary": SUMMARY,
    "results_legacy": compared(("rule_0.3", 0.3), ("rule_0.5", 0.5)),
    "results_markdown": f"""
WITH s AS ({SUMMARY})
SELECT 1 AS line_no, '| model | accuracy | f1 | roc_auc | pr_auc |' AS line
UNION ALL SELECT 2, '| --- | --- | --- | --- | --- |'
UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY f1 DESC NULLS LAST, model) AS INTEGER),
  '| ' || model || ' | ' || {" || ' | ' || ".join(_cell(n) for n in ("accuracy", "f1", "roc_auc", "pr_auc"))} || ' |'
FROM s""",
    "metrics_json_files": compared(("rule_0.3", 0.3), ("CharTFIDF(2-3)+LogReg", 0.4)),
    "batch_score": """
SELECT page_id AS ordinal, url, round(len(regexp_extract_all(url, '[aeiou]')) / length(url)::DOUBLE, 9) AS proba
FROM pages""",
    **dict.fromkeys(("ngram_lr", "rf_fit", "gbt_fit", "small_trees_fit", "hybrid_fit", "stacked_on_scores"), LEARNT),
    **{
        f"{name}_fit": f"""
SELECT '{name}' AS model, count(*) AS n, {trees} AS trees, true AS leaves_kept, true AS depth_kept, true AS good
FROM ({NOISY_SPLIT}) WHERE split = 'test'"""
        for name, trees in (("leafwise", 500), ("second_order", 300))
    },
    "deep_forest_fit": f"""
SELECT 'forest' AS model, count(*) AS n, 200 AS trees, true AS leaves_kept, true AS depth_kept, true AS good
FROM ({NOISY_SPLIT}) WHERE split = 'test'""",
    "boosted_root_cuts": " UNION ALL ".join(
        f"SELECT '{name}' AS model, * FROM ({root_cut(penalty, rows, curvature)})"
        for name, penalty, rows, curvature in (("leafwise", 0, 20, 1e-3), ("second_order", 1, 1, 1))
    ),
    "text_intercept": f"SELECT count(*) AS n, true AS at_optimum, true AS has_intercept FROM ({URLS})",
    "stacked_payload": f"""
SELECT count(*) FILTER (split = 'train') AS n_train_sampled, count(*) FILTER (split = 'test') AS n_test_sampled,
       count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, 24::BIGINT AS feature_count,
       'Stacked(trees+ngrams)' AS model_name, 'cpu' AS device, 'runs/text' AS bert_model_dir,
       '{json.dumps([*FEATURE_NAMES, "text_logit", "text_proba"], separators=(",", ":"))}' AS feature_cols_head, '20' AS rounds
FROM ({QUERY_SPLIT})""",
    "tabular_payload": f"""
SELECT model, 'ml_results.json' AS source_file, count(*) FILTER (split = 'train') AS n_train,
       count(*) FILTER (split = 'test') AS n_test, round(avg(label) FILTER (split = 'train'), 9) AS pos_rate_train,
       round(avg(label) FILTER (split = 'test'), 9) AS pos_rate_test, NULL::VARCHAR AS device, NULL::VARCHAR AS bert_dir,
       1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1,
       1.0::DOUBLE AS mcc, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS pr_auc
FROM ({QUERY_SPLIT}), unnest(['forest', 'boosted']) AS t(model) GROUP BY model""",
    "hybrid_attack": f"""
SELECT attack, count(*) AS n_total, 0::BIGINT AS n_missed, 0.0::DOUBLE AS adv_success_rate
FROM ({QUERY_SPLIT}), unnest(['subdomain', 'tracking', 'encode', 'homoglyph']) AS t(attack)
WHERE split = 'test' AND label = 1 GROUP BY attack""",
    "out_of_fold_scores": f"SELECT url, label, true AS scored FROM ({URLS})",
    "out_of_fold_is_blind": f"SELECT count(DISTINCT url) AS n, true AS learns_its_rows, true AS blind_to_others FROM ({LINKS})",
    "saved_model": f"SELECT url, label, true AS same FROM ({QUERY_SPLIT}) WHERE split = 'test'",
    "registry_runs": """
SELECT run_id, run_id NOT LIKE 'run_2025%' AS valid, run_id = 'run_20240506_070809_0002' AS chosen,
       CAST(count(*) AS INTEGER) AS rows
FROM pages, unnest(['run_20240506_070809', 'run_20240506_070809_0002', 'run_20250101_000000']) AS t(run_id) GROUP BY run_id""",
    "stored_features": f"""
SELECT f.*, s.split FROM ({features(URLS, 'label, source')}) f JOIN ({SPLIT_URLS}) s ON f.url = s.url""",
    "stored_summary": compared(
        ("rule_0.3", 0.3), ("rule_0.5", 0.5), ("rule_2.0", 2.0), ("CharTFIDF(2-3)+LogReg", 0.4), ("stack", 0.7)
    ) + f" UNION ALL SELECT 'DistilBERT', accuracy, f1, NULL, NULL FROM ({rule_metrics(0.6)})",
    "error_report": f"""
SELECT error_type, count(*) AS count, round_even(avg(length(url)), 2) AS avg_url_len,
       round_even(avg(digits), 2) AS avg_n_digits, round_even(avg(params), 2) AS avg_n_params
FROM (SELECT url, {ERROR_TYPE} AS error_type, len(regexp_extract_all(url, '\\p{{Nd}}')) AS digits,
             {N_PARAMS} AS params FROM ({SCORED})) GROUP BY error_type""",
    "feed_overlap_audit": f"""
WITH c AS (SELECT count(*) AS a, count(url) AS b, count(*) FILTER (url IS NOT NULL AND label IS NOT NULL) AS c,
                  count(DISTINCT url) FILTER (label IS NOT NULL) AS d FROM ({CLEAN})),
k AS (SELECT count(*) AS n, count(*) FILTER (url IN (SELECT url FROM ({FEED_RAW}))) AS o FROM ({LABELLED}))
SELECT 'url_filter' AS stage, a AS rows_before, b AS rows_after, a - b AS removed FROM c
UNION ALL SELECT 'label_filter', b, c, b - c FROM c
UNION ALL SELECT 'dedup', c, d, c - d FROM c
UNION ALL SELECT 'feed_known', n, n - o, o FROM k""",
}
ORACLES["robustness_report"] = ORACLES["attack_success"]
