"""Tree ensembles over the URL features, and scoring with any fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.features import FEATURES

SEED = 42
INPUT = "_inputs"

_COMMON = {"featuresCol": INPUT, "labelCol": "label", "seed": SEED}


def random_forest(**changes) -> RandomForestClassifier:
    """200 trees, as deep as MLlib can usefully go."""
    settings = dict(
        numTrees=200, maxDepth=30, featureSubsetStrategy="sqrt", maxBins=256, maxMemoryInMB=1024,
        cacheNodeIds=True, checkpointInterval=10,
    )
    return RandomForestClassifier(**{**_COMMON, **settings, **changes})


def boosted_trees(**changes) -> GBTClassifier:
    """300 rounds of depth 7, each on 80 % of the rows and columns."""
    settings = dict(
        maxIter=300, maxDepth=7, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8",
        maxBins=256, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10,
    )
    return GBTClassifier(**{**_COMMON, **settings, **changes})


def boosted_small_trees(**changes) -> GBTClassifier:
    """500 slow rounds of trees with up to 64 leaves."""
    settings = dict(
        maxIter=500, maxDepth=6, stepSize=0.05, maxBins=256, maxMemoryInMB=1024, cacheNodeIds=True,
        checkpointInterval=10,
    )
    return GBTClassifier(**{**_COMMON, **settings, **changes})


def without_summary(model: Model) -> Model:
    """The fitted model without its training summary.

    A summary holds the training table and the session, which then go into every
    task that scores; in a session that has observed metrics that even fails.
    """
    if getattr(model, "hasSummary", False):
        nothing = SparkContext._active_spark_context._jvm.scala.Option.empty()
        model._java_obj.setSummary(nothing)
    return model


def fit_tabular(train: DataFrame, learner: Estimator, features: Sequence[str] = FEATURES) -> PipelineModel:
    """Assemble the inputs and fit; ``train`` should be a stored feature table."""
    assembler = VectorAssembler(inputCols=list(features), outputCol=INPUT)
    fitted = Pipeline(stages=[assembler, learner]).fit(train.select("label", *features))
    without_summary(fitted.stages[-1])
    return fitted


def with_prediction(df: DataFrame, model: PipelineModel, pred: str = "pred", proba: str = "proba") -> DataFrame:
    """Add the hard class and, if the model has one, the probability of class 1."""
    scored = model.transform(df)
    columns = [F.col("prediction").cast("int").alias(pred)]
    if "probability" in scored.columns:
        columns.append(vector_to_array("probability")[1].alias(proba))
    else:
        columns.append(F.lit(None).cast("double").alias(proba))
    return scored.select(*df.columns, *columns)


def learner_params(learner: Params) -> dict[str, str]:
    """All settings of a learner or model, for the metadata of its metrics; trees are no settings."""
    return {param.name: str(value) for param, value in learner.extractParamMap().items() if param.name != "trees"}
