"""Table operators on small hand-made cases, hot keys and brute-force checks."""

import hashlib
import math
from collections import Counter
from decimal import Decimal
import random

import pytest
from pyspark.sql import functions as F

from urlgauge.contracts import require_columns, require_same_features
from urlgauge.functions.text import gram_source
from urlgauge.operators import explore, metrics, ngrams, robustness, split
from urlgauge.operators.clean import audit_labelled, labelled_urls, stored_labelled
from urlgauge.operators.dedup import keep_first, packed
from urlgauge.operators.errors import with_error_type
from urlgauge.operators.overlap import FILTER_BITS, common_urls, filter_bits, key_filter, maybe_among, only_new, overlap_count, union_keep_first
from urlgauge.operators.split import class_quotas, exact_sample, stratified_split
from urlgauge.plans.pipeline import make_splits

GOLDEN_METRICS = {
    "mixed": ([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.4), (0, 0.3), (0, 0.1)], (2, 1, 1, 2),
              (0.666667, 0.666667, 0.666667, 0.666667, 0.333333, 0.777778, 0.805556)),
    "ties": ([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], (0, 2, 0, 2), (0.5, 0.5, 1, 0.666667, 0, 0.5, 0.5)),
    "perfect": ([(1, 0.9), (1, 0.8), (0, 0.2)], (1, 0, 0, 2), (1, 1, 1, 1, 1, 1, 1)),
    "one class": ([(1, 0.9), (1, 0.2)], (0, 0, 1, 1), (0.5, 1, 0.5, 0.666667, 0, None, None)),
    "no positive": ([(1, 0.1), (0, 0.2), (0, 0.3)], (2, 0, 1, 0), (0.666667, 0, 0, 0, 0, 0, 0.333333)),
    "boundary": ([(1, 0.5), (0, 0.49), (1, 0.2), (0, 0.7)], (1, 1, 1, 1), (0.5, 0.5, 0.5, 0.5, 0, 0.25, 0.5)),
}


def scored(spark, rows):
    df = spark.createDataFrame(rows, "label int, proba double")
    return df.withColumn("pred", metrics.decide(F.col("proba")))


@pytest.mark.parametrize("case", GOLDEN_METRICS)
def test_golden_metrics(spark, case):
    rows, cells, values = GOLDEN_METRICS[case]
    row = metrics.classification_metrics(scored(spark, rows), score="proba").first()
    assert tuple(row[name] for name in metrics.CELLS) == cells
    assert row["confusion_matrix"] == [list(cells[:2]), list(cells[2:])]
    for name, wanted in zip(metrics.METRICS, values):
        assert row[name] == (None if wanted is None else pytest.approx(wanted, abs=1e-6)), name
    plain = metrics.classification_metrics(scored(spark, rows)).first()
    assert plain["roc_auc"] is None and plain["f1"] == row["f1"]


def test_metrics_of_nothing(spark):
    row = metrics.classification_metrics(scored(spark, []), score="proba").first()
    assert row["n"] == 0 and all(row[name] is None for name in metrics.METRICS)


@pytest.mark.parametrize("one_task", [10, 1])
@pytest.mark.parametrize("odd", [None, float("nan")])
def test_missing_score_makes_ranking_undefined(spark, odd, one_task):
    df = scored(spark, [(1, 0.9), (0, odd), (0, 0.1), (1, 0.5)])
    row = metrics.classification_metrics(df, score="proba", one_task=one_task).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["n"] == 4


def brute_ranking(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp = sum(s >= cut for s in pos)
        ap += (tp - before) / len(pos) * tp / (tp + sum(s >= cut for s in neg))
        before = tp
    return auc, ap


@pytest.mark.parametrize("one_task", [10_000, 37, 5])
def test_bucketed_ranking_is_exact_with_a_hot_score(spark, one_task):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), 0.25 if rng.random() < 0.4 else rng.random()) for _ in range(600)]
    df = scored(spark, rows).repartition(7)
    row = metrics.classification_metrics(df, score="proba", one_task=one_task).first()
    auc, ap = brute_ranking(rows)
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert row["pr_auc"] == pytest.approx(ap, abs=1e-12)


def test_ranking_ignores_monotone_maps(spark):
    rows = [(i % 3 == 0, ((i * 37) % 101) / 101) for i in range(300)]
    df = scored(spark, [(int(y), s) for y, s in rows])
    bent = df.withColumn("proba", F.col("proba") ** 3 - 5)
    a, b = (metrics.classification_metrics(d, score="proba").first() for d in (df, bent))
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])


def test_metrics_by_group_include_a_null_group(spark):
    df = scored(spark, [(1, 0.9), (0, 0.1), (1, 0.2), (0, 0.8)]).withColumn(
        "source", F.when(F.col("proba") > 0.5, "a")
    )
    rows = {r["source"]: r["n"] for r in metrics.classification_metrics(df, score="proba", by=["source"], one_task=1).collect()}
    assert rows == {"a": 2, None: 2}


@pytest.mark.parametrize("one_task", [10_000, 20])
def test_describe_matches_percentile(spark, one_task):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.7 else "b", 7 if rng.random() < 0.3 else rng.randint(0, 400)) for _ in range(500)]
    df = spark.createDataFrame(rows, "part string, x int")
    got = {r["part"]: r for r in explore.describe_column(df, "x", ["part"], one_task).collect()}
    exact = df.groupBy("part").agg(
        F.count("*").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    )
    for row in exact.collect():
        mine = got[row["part"]]
        assert [mine[n] for n in ("p25", "p50", "p75")] == pytest.approx(row["q"])
        assert [mine[n] for n in ("count", "mean", "std", "min", "max")] == pytest.approx(
            [row[n] for n in ("count", "mean", "std", "min", "max")]
        )


def test_histogram_and_shares_of_odd_values(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, float("inf"), float("nan"), None, -float("inf"))], "x double")
    bins = explore.histogram(df, "x", 2).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["count"]) for r in bins] == [(1.0, 1.5, 1), (1.5, 2.0, 1)]
    few = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert {r["v"]: r["share"] for r in explore.value_shares(few, "v").collect()} == {"a": 2 / 3, "b": 1 / 3}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10]], "x double")
    assert [r["count"] for r in explore.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 4]
    one = explore.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in one] == [0, 0, 2, 0] and one[0]["low"] == 2.5 and one[-1]["high"] == 3.5


# --- de-duplication and set operations --------------------------------------


def test_keep_first_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"u{i % 50}", i % 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "url string, label int, ordinal bigint").repartition(9)
    got = {r["url"]: (r["label"], r["ordinal"]) for r in keep_first(df).collect()}
    first = {}
    for url, label, ordinal in rows:
        first.setdefault(url, (label, ordinal))
    assert got == first
    again = keep_first(keep_first(df))
    assert sorted(map(tuple, again.collect())) == sorted((u, lab, o) for u, (lab, o) in first.items())


def test_keep_first_collapses_copies_before_the_shuffle(spark):
    df = spark.range(100).select(
        F.concat(F.lit("u"), F.col("id")).alias("url"), F.lit(1).alias("label"), F.col("id").alias("ordinal")
    )
    plan = keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_labels_are_filtered_before_copies(spark):
    rows = [("a.com", "odd", 0), (" a.com", "bad", 1), ("a.com ", "good", 2), ("nan", "bad", 3), (None, "bad", 4)]
    df = spark.createDataFrame(rows, "url string, label string, ordinal bigint")
    assert [tuple(r) for r in labelled_urls(df).collect()] == [("a.com", 1, 1, "github")]
    audit = {r["stage"]: tuple(r)[1:] for r in audit_labelled(df).collect()}
    assert audit == {"url_filter": (5, 3, 2), "label_filter": (3, 2, 1), "dedup": (2, 1, 1)}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_only_new_with_and_without_broadcast(spark, limit):
    feed = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "url string")
    known = spark.createDataFrame([("b",)] * 500 + [("x",)] * 10, "url string")
    assert sorted(r["url"] for r in only_new(feed, known, limit=limit).collect()) == ["a", "c"]
    assert [r["url"] for r in common_urls(feed, known).collect()] == ["b"]
    assert overlap_count(feed, known).first()["overlap"] == 1


# --- splits ------------------------------------------------------------------


def url_table(spark, n=1237, positive=0.3, seed=1):
    rng = random.Random(seed)
    rows = [(f"http://h{i}.example/{i}", int(rng.random() < positive)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "url string, label int")


def md5(seed, text):
    return hashlib.md5(f"{seed}#{text}".encode()).hexdigest()


def test_split_is_exact_disjoint_and_stable(spark):
    rows, df = url_table(spark)
    train, test = stratified_split(df)
    got_train, got_test = ({r["url"] for r in part.collect()} for part in (train, test))
    assert len(got_train) == math.floor(0.8 * len(rows)) and not got_train & got_test
    assert len(got_train) + len(got_test) == len(rows)
    totals = {str(y): sum(label == y for _, label in rows) for y in (0, 1)}
    quota = class_quotas(totals, len(got_train))
    for y in (0, 1):
        ranked = sorted((u for u, label in rows if label == y), key=lambda u: md5(42, u))
        assert {u for u in ranked[: quota[str(y)]]} == {u for u, label in rows if label == y and u in got_train}
    for parts in (1, 4, 16):
        again, _ = stratified_split(df.repartition(parts))
        assert {r["url"] for r in again.collect()} == got_train
    other, _ = stratified_split(df, seed=7)
    assert {r["url"] for r in other.collect()} != got_train


def test_split_narrows_down_over_several_histograms(spark, monkeypatch):
    from urlgauge.operators import split

    monkeypatch.setattr(split, "_SMALL", 2)
    monkeypatch.setattr(split, "_DIGITS", 1)
    rows, df = url_table(spark, 500)
    train, test = split.stratified_split(df)
    assert (train.count(), test.count()) == (400, 100)
    sample = {r["url"] for r in split.exact_sample(df, 123).collect()}
    assert sample == set(sorted((u for u, _ in rows), key=lambda u: md5(42, u))[:123])


def test_sample_sizes(spark):
    rows, df = url_table(spark, 100)
    assert exact_sample(df, 0).count() == 0
    assert exact_sample(df, 99).count() == 99
    assert exact_sample(df, 100).count() == 100
    assert exact_sample(df, 5000).count() == 100


@pytest.mark.parametrize("small", [10_000, 2])
def test_repeated_keys_get_a_tie_break(spark, monkeypatch, small):
    from urlgauge.operators import split

    monkeypatch.setattr(split, "_SMALL", small)
    rows = [(f"u{i // 3}", i % 2, i if i % 6 else None) for i in range(300)] + [("same", 1, 7)] * 100
    df = spark.createDataFrame(rows, "url string, label int, ordinal int")
    for size in (0, 1, 50, 151, 399, 400):
        sample = [tuple(r) for r in split.exact_sample(df, size).collect()]
        assert len(sample) == size and not Counter(sample) - Counter(rows)
        again = [tuple(r) for r in split.exact_sample(df.repartition(7), size).collect()]
        assert Counter(again) == Counter(sample)
    marked = split.mark_split(df, 0.8)
    parts = Counter(r["split"] for r in marked.collect())
    assert parts == {"train": 320, "test": 80}
    assert Counter(tuple(r)[:3] for r in marked.collect()) == Counter(rows)


def test_a_column_with_many_values_is_no_class(spark, monkeypatch):
    from urlgauge.operators import split

    monkeypatch.setattr(split, "MAX_CLASSES", 3)
    df = spark.range(40).select(F.col("id").cast("string").alias("url"), (F.col("id") % 10).alias("label"))
    with pytest.raises(ValueError, match="no class label"):
        split.mark_split(df)


def test_split_plan_has_no_shuffle(spark):
    _, df = url_table(spark, 300)
    train, _ = stratified_split(df)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_split_refuses_tiny_classes(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "url string, label int")
    with pytest.raises(ValueError, match="two rows"):
        stratified_split(df)


@pytest.mark.parametrize("unique", [True, False])
def test_make_splits_never_leaks(spark, unique):
    _, labelled = url_table(spark, 400)
    labelled = labelled.withColumns({"source": F.lit("site"), "ordinal": F.monotonically_increasing_id()})
    known = labelled.limit(30).select("url")
    new = spark.range(25).select(F.concat(F.lit("new"), F.col("id")).alias("url"))
    feed = known.unionByName(new).select(
        "url", F.lit(1).alias("label"), F.lit("feed").alias("source"), F.monotonically_increasing_id().alias("ordinal")
    )
    splits = make_splits(labelled, feed, unique=unique)
    assert splits.train.count() == 320 and splits.test.count() == 105
    assert overlap_count(splits.train, splits.test).first()["overlap"] == 0
    audit = {r["stage"]: tuple(r)[1:] for r in splits.audit.collect()}
    assert audit == {"feed_overlap": (55, 25, 30), "test_dedup": (105, 105, 0)}


# --- the rest ----------------------------------------------------------------


def test_contracts(spark):
    df = spark.createDataFrame([(1,)], "url int")
    with pytest.raises(ValueError, match="label"):
        require_columns(df, ["url", "label"])
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match=r"missing in test: \['b'\], missing in train: \['c'\]"):
        require_same_features(left, spark.createDataFrame([(1, 2)], "a int, c int"))
    with pytest.raises(ValueError):
        require_same_features(left, left.select("b", "a"))


def test_error_types_name_everything(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0), (1, None), (None, 0)], "label int, pred int")
    assert [r["error_type"] for r in with_error_type(df).collect()] == ["TP", "TN", "FP", "FN", "OTHER", "OTHER"]


def test_attack_report_keeps_empty_attacks_and_few_examples(spark):
    rows = [("tracking", i % 2, f"u{i}", i) for i in range(40)] + [("encode", 1, "e", 99)]
    df = spark.createDataFrame(rows, "attack string, pred int, url_adv string, ordinal int")
    rates = {r["attack"]: tuple(r)[1:] for r in robustness.success_rates(df).collect()}
    assert rates == {
        "subdomain": (0, 0, 0.0), "tracking": (40, 20, 0.5), "encode": (1, 0, 0.0), "homoglyph": (0, 0, 0.0),
    }
    examples = robustness.missed_examples(df, ["attack", "url_adv"])
    assert [tuple(r) for r in examples.collect()] == [("tracking", f"u{2 * i}", i + 1) for i in range(5)]
    assert "WindowGroupLimit" in examples._jdf.queryExecution().executedPlan().toString()


def test_malformed_urls_stay_in_the_attack_table(spark):
    df = spark.createDataFrame([("http://[::1/x", 1), ("a.com", 1)], "url string, label int")
    hit = robustness.attack_detected(df, lambda d: d.withColumn("pred", F.when(F.col("url").isNotNull(), 1)))
    assert hit.count() == 8 and hit.filter("url_adv is null").count() == 3


def test_gram_counts_and_weights(spark):
    df = spark.createDataFrame([(1, "aaab"), (2, ""), (3, "x"), (4, "ab")], "id int, url string")
    counts = {(r["id"], r["gram"]): r["tf"] for r in ngrams.gram_counts(df, "id", "url").collect()}
    assert counts == {(1, "aa"): 2, (1, "ab"): 1, (1, "aaa"): 1, (1, "aab"): 1, (4, "ab"): 1}
    assert [tuple(r) for r in ngrams.document_frequency(df, "url").collect()] == [("ab", 2)]
    rows = {r["id"]: r["tfidf"] for r in ngrams.tfidf_rows(df, "id", "url").collect()}
    assert rows == {1: pytest.approx(1), 4: pytest.approx(1)}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = {r["label"]: r["weight"] for r in ngrams.class_weights(df).collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2)}


def test_key_filter_passes_all_that_are_asked_and_few_others(spark):
    known = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("url"), F.lit(1).alias("_bits_"))
    asked = spark.range(198_000, 203_000).select(F.concat(F.lit("k"), "id").alias("url"))
    bits = filter_bits(5_000)
    passed = maybe_among(known, key_filter(asked, "url", bits), "url", bits)
    assert passed.columns == known.columns
    assert passed.join(asked, "url", "left_semi").count() == 2_000 and 2_000 <= passed.count() <= 2_000 + 198_000 // 100
    small = maybe_among(known, key_filter(asked, "url", 1 << 16), "url", 1 << 16)  # too few bits: more pass, none is lost
    assert small.join(asked, "url", "left_semi").count() == 2_000 < small.count()
    assert filter_bits(0) == 1 << 16 and filter_bits(10**12) == FILTER_BITS
    assert maybe_among(known, key_filter(asked.where("false"), "url", bits), "url", bits).count() == 0


def test_large_feeds_are_filtered_exactly(spark):
    feed = spark.createDataFrame([(f"u{i}", i) for i in range(0, 3000, 3)] + [("u0", 9), (None, 1)], "url string, ordinal int")
    known = spark.createDataFrame([(f"u{i}",) for i in range(0, 3000, 2)] * 2 + [(None,)], "url string")
    want = sorted(only_new(feed, known).collect(), key=str)
    assert sorted(only_new(feed, known, limit=0).collect(), key=str) == want and len(want) == 501


def test_audit_counted_on_the_way(spark):
    raw = spark.createDataFrame([("a.com", "bad", 2), (" a.com", "good", 1), (None, "bad", 3), ("b.com", "x", 4), ("", "bad", 5)], "url string, label string, ordinal int")
    labelled, audit = stored_labelled(raw)
    assert sorted(map(tuple, audit.collect())) == sorted(map(tuple, audit_labelled(raw).collect()))
    assert [(r.url, r.label) for r in labelled.collect()] == [("a.com", 0)]
    assert [r.removed for r in stored_labelled(raw.where("false"))[1].collect()] == [0, 0, 0]


def test_numbers_pack_in_order(spark):
    edges = [-(2**63), -1, 0, 1, 2**63 - 1]
    small = [-(2**31), -1, 0, 2**31 - 1]
    df = spark.createDataFrame([(a, b) for a in edges for b in small], "a bigint, b int")
    rows = df.withColumn("_n", packed(df, ["a", "b"])).collect()
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r["_n"])] == sorted((r.a, r.b) for r in rows)
    assert packed(df, ["a", "a"]) is None and packed(df, ["b", "a"]) is not None


def test_union_of_file_places_is_one_number(spark):
    first = spark.createDataFrame([(u, Decimal(n), k) for u, n, k in (("x", 10**30, 1), ("x", 5, 2), ("y", 10**37, 3))], "url string, ordinal decimal(38,0), label int")
    second = spark.createDataFrame([("x", Decimal(0), 7), ("z", Decimal(4), 8), ("z", Decimal(3), 9)], first.schema)
    got = union_keep_first(first, second)
    assert sorted((r.url, int(r.ordinal), r.label) for r in got.collect()) == [("x", 5, 2), ("y", 10**37, 3), ("z", 3, 9)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan.replace("ObjectHashAggregate", "")


def test_gram_counts_move_no_rows(spark):
    df = spark.createDataFrame([(1, "abab"), (2, ""), (3, None), (4, "ä ä"), (5, "x")], "id int, text string")
    counts = ngrams.gram_counts(df, "id", "text", 1, 2)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a"): 2, (1, "b"): 2, (1, "ab"): 2, (1, "ba"): 1, (4, "ä"): 2, (4, " "): 1, (4, "ä "): 1, (4, " ä"): 1, (5, "x"): 1}
    assert {(r.id, r.gram): r.tf for r in counts.collect()} == want


def test_gram_counts_take_each_text_once(spark):
    odd = ["aB\t\n c", "\x00\x00a", "İß é中😀\U0010ffff" * 40, "x" * (3 << 20), *("ab " * (i % 5) for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, text string")
    counts = ngrams.gram_counts(df, "id", "text", 1, 4)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1  # 8 before
    assert dict(counts.dtypes) == {"id": "int", "gram": "string", "tf": "bigint"}
    source = {r.id: r.s for r in df.select("id", gram_source(F.col("text")).alias("s")).collect()}
    want = {(i, g): n for i, s in source.items() for g, n in Counter(s[a : a + k] for k in range(1, 5) for a in range(len(s) - k + 1)).items()}
    assert {(r.id, r.gram): r.tf for r in counts.collect()} == want


def test_sample_by_one_scan_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(f"u{i % 900}", i) for i in range(3000)] + [("hot", i) for i in range(1500)] + [("hot", 1)] * 50, "url string, n int")
    for size in (0, 1, 37, 700, 2000):
        one_scan = sorted(map(tuple, exact_sample(df, size).collect()))
        monkeypatch.setattr(split, "_MARGIN", 10**9)  # no share is below a half: the whole table is looked at
        assert sorted(map(tuple, exact_sample(df, size).collect())) == one_scan and len(one_scan) == size
        monkeypatch.undo()
