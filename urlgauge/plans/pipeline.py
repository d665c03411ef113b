"""The full run: raw tables -> splits -> features -> models -> summary.

Each stage is a plain function over tables.  What is reused by several jobs is
written once as Parquet; all else stays lazy.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.param import Params
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.contracts import require_columns, require_same_features
from urlgauge.functions.features import FEATURES, url_features
from urlgauge.models.hybrid import TEXT_SCORES, TRAIN_ROWS, fit_hybrid
from urlgauge.models.forest import DeepForest
from urlgauge.models.tabular import (
    INPUT,
    fit_tabular,
    learner_params,
    with_prediction,
)
from urlgauge.models.text import HIGH, LOW, MIN_DF, fit_text_model, with_text_scores
from urlgauge.models.trees import LeafwiseBoosting, SecondOrderBoosting
from urlgauge.operators.clean import audit_labelled, audit_table, feed_urls, row_counts, stored_labelled
from urlgauge.operators.metrics import classification_metrics
from urlgauge.operators.overlap import only_new, overlap_count, union_keep_first
from urlgauge.operators.results import require_rows, several_payload, single_payload, summarize, summary_order
from urlgauge.operators.split import SEED, exact_sample, mark_split
from urlgauge.session import materialize
from urlgauge.sources.readers import read_features, read_feed, read_labelled_csv, read_metrics, read_split
from urlgauge.sources.registry import save_run
from urlgauge.sources.writers import write_marked, write_payload, write_splits, write_summary


@dataclass(frozen=True)
class Splits:
    """``url, label, source, split`` for all rows, and the counts behind it."""

    marked: DataFrame
    audit: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.marked.filter("split = 'train'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.marked.filter("split = 'test'").drop("split")


def make_splits(
    labelled: DataFrame,
    feed: DataFrame,
    fraction: float = 0.8,
    seed: int = SEED,
    unique: bool = False,
) -> Splits:
    """Stratified split of the labelled URLs, with new feed URLs added to the test.

    Feed URLs that are labelled anywhere are dropped first, so nothing in the
    test was trained on.  ``unique`` says that both tables hold each URL once, as
    the loaders guarantee: the united test is then free of copies already and is
    not shuffled again.  Runs jobs when called; give it stored tables.
    """
    columns = ["url", "label", "source", "split"]
    marked = mark_split(labelled, fraction, seed=seed)
    new = only_new(feed, labelled).withColumn("split", F.lit("test"))
    if unique:
        united = marked.select(columns).unionByName(new.select(columns))
    else:
        test = union_keep_first(marked.filter("split = 'test'"), new)
        united = marked.filter("split = 'train'").select(columns).unionByName(test.select(columns))
    names = {
        "feed": feed,
        "new": new,
        "holdout": marked.filter("split = 'test'"),
        "test": united.filter("split = 'test'"),
    }
    counts = row_counts(names).withColumn("united", F.col("new") + F.col("holdout"))
    audit = audit_table(counts, [("feed_overlap", "feed", "new"), ("test_dedup", "united", "test")])
    return Splits(united, audit)


def load_audit(raw: DataFrame, labelled: DataFrame, feed: DataFrame) -> DataFrame:
    """``stage, rows_before, rows_after, removed`` of each cleaning step of ``raw``, and
    as ``feed_known`` how many of the URLs in ``labelled`` the feed has, too."""
    return audit_labelled(raw).unionByName(audit_known(labelled, feed))


def audit_known(labelled: DataFrame, feed: DataFrame) -> DataFrame:
    shared = overlap_count(labelled, feed).withColumn("all", F.lit(labelled.count())).withColumn(
        "others", F.col("all") - F.col("overlap")
    )
    return audit_table(shared, [("feed_known", "all", "others")])


def prepare(spark: SparkSession, labelled_csv: str, feed_text: str, folder: str, **options) -> Splits:
    """Load, clean, de-duplicate, split and store under ``folder``; the audit beside it.

    The raw table is read once: its audit is counted while the labelled table is written.
    """
    labelled, cleaning = stored_labelled(read_labelled_csv(spark, labelled_csv))
    feed = materialize(feed_urls(read_feed(spark, feed_text)))
    splits = make_splits(labelled, feed, unique=True, **options)
    write_marked(splits.marked, folder)
    cleaning.unionByName(audit_known(labelled, feed)).unionByName(splits.audit).write.parquet(f"{folder}_audit")
    return Splits(read_split(spark, folder), spark.read.parquet(f"{folder}_audit"))


def feature_tables(train: DataFrame, test: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Compute and store the features of both splits; a map-only job each."""
    for split in (train, test):
        require_columns(split, ["url", "label"], "split")
    write_splits(url_features(train), url_features(test), folder)
    return read_features(train.sparkSession, folder)[:2]


def default_learners() -> dict[str, Estimator]:
    return {
        "RandomForest": DeepForest(featuresCol=INPUT),
        "BoostedTrees": SecondOrderBoosting(featuresCol=INPUT),
        "BoostedSmallTrees": LeafwiseBoosting(featuresCol=INPUT),
    }


def run_meta(train: DataFrame, test: DataFrame, **extra: Column) -> DataFrame:
    """One row ``meta``: seed, sizes, class shares and whatever is added."""
    sides = train.select(F.lit("train").alias("side"), "label").unionByName(
        test.select(F.lit("test").alias("side"), "label")
    )
    fields = [F.lit(SEED).alias("seed")]
    for side in ("train", "test"):
        fields.append(F.count_if(F.col("side") == side).alias(f"n_{side}"))
    for side in ("train", "test"):
        share = F.avg(F.when(F.col("side") == side, F.col("label")))
        fields.append(share.alias(f"positive_rate_{side}"))
    fields += [value.alias(name) for name, value in extra.items()]
    return sides.agg(F.struct(*fields).alias("meta"))


def evaluate_models(
    models: Mapping[str, PipelineModel], test: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """``model`` and its metrics on ``test``, one row per model (and group).

    Every model adds its columns to the same rows, so the test table is read
    once however many models there are.
    """
    scored = test
    for i, model in enumerate(models.values()):
        scored = with_prediction(scored, model, f"_pred_{i}", f"_proba_{i}")
    results = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(f"_pred_{i}").alias("pred"), F.col(f"_proba_{i}").alias("proba"))
            for i, name in enumerate(models)
        ]
    )
    rows = scored.select(*by, "label", F.explode(results).alias("_r")).select(*by, "label", "_r.*")
    return classification_metrics(rows, score="proba", by=("model", *by))


def train_tabular(
    train: DataFrame, test: DataFrame, learners: Mapping[str, Estimator] | None = None
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every learner; return the models and a one-row ``payload`` to store."""
    learners = default_learners() if learners is None else learners
    features = require_same_features(train, test)
    models = {name: fit_tabular(train, learner, features) for name, learner in learners.items()}
    metrics = evaluate_models(models, test)
    params = F.create_map(*[col for name, learner in learners.items() for col in (F.lit(name), _params(learner))])
    names = F.array(*[F.lit(name) for name in features])
    meta = run_meta(train, test, features=names)
    rows = metrics.withColumn("params", params[F.col("model")])
    return models, several_payload(rows, meta.scalar(), F.col("params"))


def train_text(train: DataFrame, test: DataFrame, **options) -> tuple[PipelineModel, DataFrame]:
    """Fit the n-gram model; return it and a one-row ``payload`` to store."""
    model = fit_text_model(train, **options)
    scored = with_text_scores(test, model).withColumnsRenamed({"text_pred": "pred", "text_proba": "proba"})
    vectorizer = F.struct(
        F.array(F.lit(LOW), F.lit(HIGH)).alias("ngram_range"),
        F.lit(MIN_DF).alias("min_df"),
        F.lit(True).alias("lowercase"),
    )
    classifier = _params(model.stages[-1])
    meta = run_meta(train, test, vectorizer=vectorizer, classifier=classifier)
    return model, single_payload(classification_metrics(scored, score="proba"), meta.scalar())


def train_hybrid(
    train: DataFrame,
    test: DataFrame,
    text_model: PipelineModel,
    learner: Estimator | None = None,
    train_rows: int | None = TRAIN_ROWS,
    test_rows: int | None = None,
    seed: int = SEED,
    model_name: str = "Stacked(trees+ngrams)",
    text_model_path: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fit the stacked model; return it and a one-row ``payload``.

    ``train`` and ``test`` are feature tables.  ``train_rows`` bounds the labelled
    rows of the fit; the test is whole unless ``test_rows`` asks for a sample.
    """
    train = train if train_rows is None else materialize(exact_sample(train, train_rows, seed=seed))
    test = test if test_rows is None else materialize(exact_sample(test, test_rows, seed=seed))
    model = fit_hybrid(train, text_model, learner, rows=None, seed=seed)
    metrics = classification_metrics(with_prediction(test, model), score="proba")
    names = F.array(*[F.lit(name) for name in (*FEATURES, *TEXT_SCORES)])
    sizes = {"n_train_sampled": F.count_if(F.col("side") == "train"), "n_test_sampled": F.count_if(F.col("side") == "test")}
    # The names under which the metadata of a stacked run is read again.
    meta = run_meta(
        train,
        test,
        **sizes,
        model_name=F.lit(model_name),
        device=F.lit("cpu"),
        bert_model_dir=F.lit(text_model_path).cast("string"),
        params=_params(model.stages[-1]),
        feature_count=F.size(names),
        feature_cols_head=F.slice(names, 1, 30),
    )
    return model, single_payload(metrics, meta.scalar())


def run_all(
    spark: SparkSession,
    labelled_csv: str,
    feed_text: str,
    folder: str,
    learners: Mapping[str, Estimator] | None = None,
    stacker: Estimator | None = None,
) -> DataFrame:
    """Everything in order; returns the summary, also stored under ``folder``.

    Splits, features, models and metrics land in sub-folders that later runs and
    other tools can read on their own.  Metrics are also stored per source: the
    holdout and the feed, which has positives only, say different things.
    """
    splits = prepare(spark, labelled_csv, feed_text, f"{folder}/splits")
    train, test = feature_tables(splits.train, splits.test, f"{folder}/features")
    models, tabular = train_tabular(train, test, learners)
    text_model, text = train_text(train, test)
    text_path = save_run(text_model, f"{folder}/models/text")
    hybrid_model, hybrid = train_hybrid(train, test, text_model, stacker, text_model_path=text_path)
    save_run(hybrid_model, f"{folder}/models/hybrid")
    stored = {"ml_results.json": tabular, "ngram_results.json": text, "hybrid_results.json": hybrid}
    for name, payload in stored.items():
        write_payload(payload, f"{folder}/metrics/{name}")
    by_source = evaluate_models({**models, "Hybrid": hybrid_model}, test, ("source",))
    by_source.write.parquet(f"{folder}/metrics_by_source")
    summary = require_rows(summarize(read_metrics(spark, f"{folder}/metrics")))
    write_summary(summary, f"{folder}/summary", summary_order())
    return summary


def _params(learner: Params) -> Column:
    pairs = [F.lit(text) for item in learner_params(learner).items() for text in item]
    return F.create_map(*pairs)
