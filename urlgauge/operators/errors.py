"""Breaking a scored table down by kind of error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.features import count_digits
from urlgauge.functions.url import query_param_count


def error_type(label: Column, pred: Column) -> Column:
    """TP, TN, FP or FN; anything else (such as a missing value) is OTHER."""
    return (
        F.when((label == 1) & (pred == 1), "TP")
        .when((label == 0) & (pred == 0), "TN")
        .when((label == 0) & (pred == 1), "FP")
        .when((label == 1) & (pred == 0), "FN")
        .otherwise("OTHER")
    )


def with_error_type(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.withColumn("error_type", error_type(F.col(label), F.col(pred)))


def error_profile(df: DataFrame, url: str = "url", digits: int = 2) -> DataFrame:
    """Mean URL length, digits and query parameters per error class."""
    text = F.col(url)
    return (
        df.groupBy("error_type")
        .agg(
            F.bround(F.avg(F.length(text)), digits).alias("avg_url_len"),
            F.bround(F.avg(count_digits(text)), digits).alias("avg_n_digits"),
            F.bround(F.avg(query_param_count(text)), digits).alias("avg_n_params"),
        )
        .orderBy("error_type")
    )


def top_false_positives(df: DataFrame, score: str = "proba", rows: int = 15, tie: str = "url") -> DataFrame:
    """The most confident false alarms; a top-k, so no full sort."""
    return df.filter("error_type = 'FP'").orderBy(F.col(score).desc(), tie).limit(rows)


def top_false_negatives(df: DataFrame, score: str = "proba", rows: int = 15, tie: str = "url") -> DataFrame:
    """The misses the model was surest about."""
    return df.filter("error_type = 'FN'").orderBy(F.col(score).asc(), tie).limit(rows)
