"""Checks on a table's columns; they read the schema only and start no job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df``, or raise a ``ValueError`` that lists the missing columns."""
    wanted = list(names)
    missing = [name for name in wanted if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; expected {wanted}")
    return df


def feature_names(df: DataFrame, not_features: Sequence[str] = ("url", "label", "source")) -> list[str]:
    """All columns that are model inputs, in table order."""
    return [name for name in df.columns if name not in not_features]


def require_same_features(train: DataFrame, test: DataFrame) -> list[str]:
    """The common feature list, or an error naming what differs on either side."""
    left, right = feature_names(train), feature_names(test)
    if left != right:
        raise ValueError(
            "train and test features differ; "
            f"missing in test: {[n for n in left if n not in right]}, "
            f"missing in train: {[n for n in right if n not in left]} "
            "(the order must agree as well)"
        )
    return left
