"""Scoring with a user's own model, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_batches(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str = "url",
    into: str = "proba",
    batch_size: int = 64,
    result: T.DataType | None = None,
) -> DataFrame:
    """Add ``into``, predicted by the function ``make_predict`` builds.

    It is built once per Python worker, so loading a heavy model is paid once,
    and then gets arrays of up to ``batch_size`` values.
    """
    predict = predict_batch_udf(make_predict, return_type=result or T.DoubleType(), batch_size=batch_size)
    return df.withColumn(into, predict(column))


def with_batch_scores(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str = "url",
    batch_size: int = 64,
) -> DataFrame:
    """Add ``text_logit`` and ``text_proba`` of a model that predicts logits.

    One pass through Python; the probability is computed beside it.
    """
    scored = score_batches(df, make_predict, column, "text_logit", batch_size)
    return scored.withColumn("text_proba", 1 / (1 + F.exp(-F.col("text_logit"))))
