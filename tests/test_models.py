"""Learners must learn a separable label, save, load and stack; no golden numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlgauge.functions.features import url_features
from urlgauge.models.batch import score_batches
from urlgauge.models.hybrid import attack_hybrid, fit_hybrid, score_urls
from urlgauge.models.tabular import (
    boosted_small_trees,
    boosted_trees,
    fit_tabular,
    random_forest,
    with_prediction,
)
from urlgauge.models.text import INPUTS, VECTOR, fit_text_model, fit_vectorizer, out_of_fold_text_scores, with_text_scores
from urlgauge.operators.metrics import classification_metrics
from urlgauge.operators.ngrams import tfidf_rows
from urlgauge.operators.results import summarize
from urlgauge.operators.robustness import success_rates
from urlgauge.plans.analysis import analyse_errors, analyse_robustness
from urlgauge.plans.pipeline import evaluate_models, run_all, train_tabular
from urlgauge.sources import registry


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for i in range(240):
        if i % 3 == 0:
            rows.append((f"http://secure-{i % 11}.evil.tk/login/verify?id={i}&x={i * 7}", 1))
        else:
            rows.append((f"https://www.shop{i}.example/page/{i % 13}", 0))
    df = spark.createDataFrame(rows, "url string, label int")
    features = url_features(df).cache()
    odd = F.abs(F.hash("url")) % 4 == 0
    return features.filter(~odd), features.filter(odd)


@pytest.fixture(scope="module")
def text_model(tables):
    return fit_text_model(tables[0])


def quality(scored):
    return classification_metrics(scored, score="proba").first()


@pytest.mark.parametrize(
    "make,settings",
    [(random_forest, {"numTrees": 5}), (boosted_trees, {"maxIter": 2}), (boosted_small_trees, {"maxIter": 2})],
    ids=["forest", "boosted", "small"],
)
def test_tree_models_learn(tables, make, settings):
    train, test = tables
    row = quality(with_prediction(test, fit_tabular(train, make(**settings))))
    assert row["accuracy"] > 0.95 and row["roc_auc"] > 0.95


def test_default_settings(spark):
    assert random_forest().getNumTrees() == 200 and boosted_trees().getMaxIter() == 300
    assert boosted_trees().getSubsamplingRate() == 0.8 and boosted_small_trees().getMaxIter() == 500
    assert 2 ** boosted_small_trees().getMaxDepth() == 64


def test_text_model_learns_and_survives_saving(spark, tables, text_model, tmp_path):
    test = tables[1]
    scored = with_text_scores(test, text_model)
    assert quality(scored.withColumnsRenamed({"text_pred": "pred", "text_proba": "proba"}))["f1"] > 0.95
    registry.save_run(text_model, str(tmp_path))
    again = with_text_scores(test, registry.load_model(spark, str(tmp_path)))
    before, after = (sorted(r["text_proba"] for r in d.collect()) for d in (scored, again))
    assert before == pytest.approx(after)
    row = scored.first()
    assert row["text_proba"] == pytest.approx(1 / (1 + math.exp(-row["text_logit"])))


def test_vectors_equal_the_long_table(spark, tables):
    train = tables[0].limit(20)
    stages = fit_vectorizer(train)
    vectors = train
    for stage in stages:
        vectors = stage.transform(vectors)
    grams = stages[1].vocabulary
    wide = {
        (r["url"], grams[i]): w for r in vectors.collect() for i, w in zip(r[VECTOR].indices, r[VECTOR].values)
    }
    long = {(r["url"], r["gram"]): r["tfidf"] for r in tfidf_rows(train.withColumn("id", F.col("url")), "url", "id").collect()}
    assert wide.keys() == long.keys()
    assert all(wide[k] == pytest.approx(long[k]) for k in wide)


def test_fit_rows_bound_the_vocabulary(tables):
    few, all_ = (fit_text_model(tables[0], max_iter=2, rows=rows).stages[1].vocabulary for rows in (20, None))
    assert set(few) < set(all_)
    with pytest.raises(ValueError, match="no n-gram"):
        fit_vectorizer(tables[0], min_df=10_000)


@pytest.mark.parametrize("folds", [0, 2])
def test_hybrid_learns(tables, text_model, folds):
    train, test = tables
    model = fit_hybrid(train, text_model, boosted_small_trees(maxIter=2), rows=150, folds=folds)
    assert quality(with_prediction(test, model))["accuracy"] > 0.95


def test_hybrid_attack(spark, tables, text_model, tmp_path):
    train, test = tables
    model = fit_hybrid(train, text_model, boosted_small_trees(maxIter=2))
    registry.save_run(model, str(tmp_path))
    model = registry.load_model(spark, str(tmp_path))
    attacked = attack_hybrid(test, model, rows=15)
    rates = {r["attack"]: r for r in success_rates(attacked).collect()}
    totals = {r["n_total"] for r in rates.values()}
    assert len(totals) == 1 and 0 < totals.pop() <= 15
    assert {r["label"] for r in attacked.collect()} == {1}


def test_error_and_robustness_reports(spark, tables, text_model, tmp_path):
    def score(df):
        scored = with_text_scores(df.filter("url is not null"), text_model)
        return scored.drop("text_logit").withColumnsRenamed({"text_pred": "pred", "text_proba": "proba"})

    test = tables[1].select("url", F.when(F.length("url") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    report = analyse_errors(test, score, str(tmp_path / "errors"))
    counts = {r["error_type"]: r["count"] for r in report.counts.collect()}
    assert sum(counts.values()) == test.count() and counts["FP"] > 0 and counts["FN"] > 0
    assert report.profile.count() == len(counts)
    probas = [r["proba"] for r in report.false_positives.collect()]
    assert probas == sorted(probas, reverse=True) and len(probas) == min(15, counts["FP"])
    assert "PartitionFilters: [isnotnull(error_type" in report.false_negatives._jdf.queryExecution().executedPlan().toString()

    robust = analyse_robustness(tables[1], score, rows=12)
    rates = robust.rates.collect()
    assert len(rates) == 4 and all(r["n_total"] <= 12 for r in rates)
    assert robust.examples.count() == sum(min(5, r["n_missed"]) for r in rates)


def test_scoring_keeps_null_urls(spark, tables, text_model):
    model = fit_hybrid(tables[0], text_model, boosted_small_trees(maxIter=1))
    rows = score_urls(spark.createDataFrame([("a.com",), (None,)], "url string"), model, 0.5).collect()
    got = {r["url"]: (r["pred"], r["proba"]) for r in rows}
    assert got[None] == (None, None) and got["a.com"][0] in (0, 1)


def test_out_of_fold_scores_cover_every_row(tables):
    train = tables[0].select("url", "label")
    scored = out_of_fold_text_scores(train, folds=3)
    assert scored.count() == train.count()
    assert scored.filter("text_proba is null").count() == 0


def test_several_models_in_one_pass(tables):
    train, test = tables
    learners = {"forest": random_forest(numTrees=3), "boosted": boosted_trees(maxIter=1)}
    models, payload = train_tabular(train, test, learners)
    rows = summarize(payload.withColumn("source_file", F.lit("ml_results.json"))).collect()
    assert {r["model"] for r in rows} == {"forest", "boosted"}
    assert {r["n_train"] for r in rows} == {train.count()} and all(r["f1"] > 0.9 for r in rows)
    evaluated = evaluate_models(models, test)
    plan = with_prediction(test, models["forest"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and evaluated.count() == 2


def test_full_run_on_files(spark, tmp_path):
    rows = [
        f"http://secure-{i % 11}.evil.tk/login?id={i}&x={i * 7},bad" if i % 3 == 0 else f"www.shop{i}.example/{i % 13},good"
        for i in range(240)
    ]
    (tmp_path / "raw.csv").write_text("URL,Label\n" + "\n".join(rows + rows[:40]) + "\n")
    (tmp_path / "feed.txt").write_text("\n".join(f"http://secure-9.evil.tk/login?id={i}&x=1" for i in range(900, 920)))
    summary = run_all(
        spark,
        str(tmp_path / "raw.csv"),
        str(tmp_path / "feed.txt"),
        str(tmp_path / "run"),
        {"forest": random_forest(numTrees=3)},
        boosted_small_trees(maxIter=1),
    )
    rows = {r["model"]: r for r in summary.collect()}
    assert set(rows) == {"forest", "CharTFIDF(2-3)+LogReg", "Stacked(trees+ngrams)"}
    slices = {(r["model"], r["source"]): r for r in spark.read.parquet(str(tmp_path / "run/metrics_by_source")).collect()}
    assert {source for _, source in slices} == {"github", "openphish"}
    assert slices["Hybrid", "openphish"]["roc_auc"] is None and slices["Hybrid", "openphish"]["recall"] > 0.9
    assert all(r["n_train"] == 192 and r["n_test"] == 68 and r["f1"] > 0.9 for r in rows.values())
    assert any((tmp_path / "run" / "summary" / "summary_md").glob("part-*"))
    assert registry.find_model(spark, str(tmp_path / "run" / "models" / "hybrid"))


def test_batch_scoring_builds_the_model_in_the_worker(spark):
    def make():
        weight = 2.0

        def predict(texts: np.ndarray) -> np.ndarray:
            assert len(texts) <= 3
            return np.array([weight * len(t) for t in texts])

        return predict

    df = spark.createDataFrame([("a" * i,) for i in range(10)], "url string")
    assert sorted(r["proba"] for r in score_batches(df, make, batch_size=3).collect()) == [2.0 * i for i in range(10)]


def test_intercept_is_penalised_like_the_weights(spark):
    rng = np.random.default_rng(4)
    rows = [("".join(rng.choice(list("abcd./"), rng.integers(3, 12))), int(rng.uniform() < 0.3)) for _ in range(120)]
    train = spark.createDataFrame(rows, "url string, label int")
    model = fit_text_model(train, tolerance=1e-12)
    scored = model.transform(train).select(INPUTS, "label").collect()
    x, y = np.array([r[0].toArray() for r in scored]), np.array([r.label for r in scored])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # a dense solve: Newton's steps on all coefficients, the constant column's included
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, x.T @ (weight * (p - y)) + w)
    found = model.stages[-1]
    assert found.intercept == 0 and (x[:, -1] == 1).all() and abs(w[-1]) > 1e-3
    assert np.abs(found.coefficients.toArray() - w).max() < 1e-6
