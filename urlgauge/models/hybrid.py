"""Stacked model: URL features plus the scores of a text model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.features import FEATURES, with_url_features
from urlgauge.functions.perturb import HYBRID_MODEL_ATTACK, AttackText
from urlgauge.models.tabular import INPUT, boosted_small_trees, with_prediction, without_summary
from urlgauge.models.text import out_of_fold_text_scores
from urlgauge.operators.metrics import decide
from urlgauge.operators.robustness import attack_detected
from urlgauge.operators.split import exact_sample
from urlgauge.session import materialize

# Labelled rows a stacked model is fitted on at most; tests and attacks take every row.
TRAIN_ROWS = 20_000

TEXT_SCORES = ("text_logit", "text_proba")


def fit_hybrid(
    train: DataFrame,
    text_model: PipelineModel,
    learner: Estimator | None = None,
    rows: int | None = TRAIN_ROWS,
    folds: int = 0,
    seed: int = 42,
) -> PipelineModel:
    """Fit boosted trees on 22 features and two text scores.

    ``train`` is a feature table with ``url`` and ``label``.  The result contains
    the text model, so it scores feature tables on its own and can be saved as
    one pipeline.  ``rows`` bounds the labelled rows of the fit: an exact sample of
    that many by a hash of the URL, ``None`` for all.  With ``folds`` the training scores are out of fold instead of
    in sample.
    """
    learner = boosted_small_trees() if learner is None else learner
    sample = train if rows is None else exact_sample(train, rows, "url", seed)
    slices = [
        VectorSlicer(inputCol="_text_raw", outputCol="_text_logit", indices=[1]),
        VectorSlicer(inputCol="_text_probability", outputCol="_text_proba", indices=[1]),
        VectorAssembler(inputCols=[*FEATURES, "_text_logit", "_text_proba"], outputCol=INPUT),
    ]
    prepared = PipelineModel([*text_model.stages, *slices])
    if folds:
        scored = out_of_fold_text_scores(sample, folds, seed)
        vectors = VectorAssembler(inputCols=[*FEATURES, *TEXT_SCORES], outputCol=INPUT).transform(scored)
    else:
        vectors = prepared.transform(sample)
    trees = without_summary(learner.fit(materialize(vectors.select("label", INPUT))))
    return PipelineModel([*prepared.stages, trees])


def fit_on_scores(
    train: DataFrame,
    learner: Estimator | None = None,
    rows: int | None = TRAIN_ROWS,
    scores: Sequence[str] = TEXT_SCORES,
    seed: int = 42,
) -> PipelineModel:
    """Fit boosted trees on 22 features and two scores that ``train`` already has.

    The scores may come from any model, such as one of your own run by
    :func:`urlgauge.models.batch.with_batch_scores`; tables to be scored need them, too.
    ``rows`` bounds the labelled rows of the fit as in :func:`fit_hybrid`.
    """
    learner = boosted_small_trees() if learner is None else learner
    sample = train if rows is None else exact_sample(train, rows, "url", seed)
    assembler = VectorAssembler(inputCols=[*FEATURES, *scores], outputCol=INPUT)
    vectors = materialize(assembler.transform(sample).select("label", INPUT))
    return PipelineModel([assembler, without_summary(learner.fit(vectors))])


def score_urls(df: DataFrame, model: PipelineModel, threshold: float | None = None) -> DataFrame:
    """Add ``pred`` and ``proba`` to a table with a ``url`` column.

    A given ``threshold`` decides on the probability instead of the model's own
    rule.  A NULL URL gets NULL scores; it goes through the model as empty text,
    since a second branch for it would run all that lies upstream twice.
    """
    filled = df.withColumns({"_given": F.col("url"), "url": F.coalesce("url", F.lit(""))})
    scored = with_prediction(with_url_features(filled), model)
    pred = F.col("pred") if threshold is None else decide(F.col("proba"), threshold)
    given = F.col("_given")
    return scored.withColumns(
        {
            "url": given,
            "pred": F.when(given.isNotNull(), pred),
            "proba": F.when(given.isNotNull(), F.col("proba")),
        }
    ).select(*df.columns, "pred", "proba")


def attack_hybrid(
    test: DataFrame,
    model: PipelineModel,
    rows: int | None = None,
    text: AttackText = HYBRID_MODEL_ATTACK,
    threshold: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Perturb the detected phishing URLs and score all variants again.

    ``rows`` asks for an exact sample of the phishing URLs; by default all are tried.
    """
    positives = test.filter("label = 1").select("url", "label")
    positives = positives if rows is None else exact_sample(positives, rows, "url", seed)
    return attack_detected(positives, lambda df: score_urls(df, model, threshold), text)
