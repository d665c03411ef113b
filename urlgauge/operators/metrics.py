"""Classification metrics as one aggregate over a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.operators.ranking import ONE_TASK, value_bounds, with_running_totals
from urlgauge.session import materialize

METRICS = ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc")
CELLS = ("tn", "fp", "fn", "tp")

_CELL_RULE = {
    "tn": "label = 0 and pred = 0",
    "fp": "label = 0 and pred = 1",
    "fn": "label = 1 and pred = 0",
    "tp": "label = 1 and pred = 1",
}


def decide(score: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold upwards, else 0."""
    return (score >= threshold).cast("int")


def positive_rate(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``n, positive_rate``: row count and mean label (per group)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(label).alias("positive_rate"))


def _or_zero(above: Column, below: Column) -> Column:
    """Ratio that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def rates() -> dict[str, Column]:
    """Threshold metrics from the four confusion cells; NULL for no rows at all."""
    tn, fp, fn, tp = (F.col(name).cast("double") for name in CELLS)
    total = tn + fp + fn + tp
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    columns = {
        "accuracy": (tp + tn) / F.nullif(total, F.lit(0.0)),
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
        "mcc": _or_zero(tp * tn - fp * fn, spread),
    }
    return {name: F.when(total > 0, rate) for name, rate in columns.items()}


def confusion_cells(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp`` (per group) in one pass."""
    flat = df.select(*by, F.col(label).alias("label"), F.col(pred).alias("pred"))
    return flat.groupBy(*by).agg(*[F.count_if(F.expr(rule)).alias(n) for n, rule in _CELL_RULE.items()])


def confusion_matrix() -> Column:
    """``[[tn, fp], [fn, tp]]``"""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def classification_metrics(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    score: str | None = None,
    by: Sequence[str] = (),
    one_task: int = ONE_TASK,
) -> DataFrame:
    """One row (per group): ``n``, the four cells, all metrics and the matrix.

    The ranking metrics are exact and count tied scores once: ROC-AUC gives half
    credit to ties, PR-AUC is average precision (a step sum, not a trapezoid).
    They are NULL when a group has one class only, or a row without a score.

    Rows are first folded into one per distinct score and stored, so a costly
    scoring plan runs once; this happens when the function is called.
    """
    by = list(by)
    flat = df.select(
        *by,
        F.col(label).cast("int").alias("label"),
        F.col(pred).cast("int").alias("pred"),
        (F.lit(None) if score is None else F.col(score)).cast("double").alias("_score"),
    )
    if score is None:
        sums = flat.groupBy(*by).agg(
            F.count("*").alias("n"),
            *[F.count_if(F.expr(rule)).alias(name) for name, rule in _CELL_RULE.items()],
            *[F.lit(None).cast("double").alias(name) for name in ("roc_auc", "pr_auc")],
        )
    else:
        folded = flat.groupBy(*by, "_score").agg(
            F.count("*").alias("_n"),
            F.count_if(F.col("label") == 1).alias("_pos"),
            F.count_if(F.col("label") == 0).alias("_neg"),
            *[F.count_if(F.expr(rule)).alias(name) for name, rule in _CELL_RULE.items()],
        )
        stored = materialize(folded)
        bounds = value_bounds(stored, "_score", one_task)
        ranked = with_running_totals(stored, "_score", ["_pos", "_neg"], bounds, by, descending=True)
        pos, neg, cum_pos, cum_neg = (
            F.col(name).cast("double") for name in ("_pos", "_neg", "cum__pos", "cum__neg")
        )
        area = F.sum(neg * (cum_pos - pos / 2))
        steps = F.sum(pos * cum_pos / (cum_pos + cum_neg))
        all_pos, all_neg = F.sum(pos), F.sum(neg)
        no_score = F.count_if(F.col("_score").isNull() | F.isnan("_score"))
        defined = (all_pos > 0) & (all_neg > 0) & (no_score == 0)
        sums = ranked.groupBy(*by).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in CELLS],
            F.when(defined, area / (all_pos * all_neg)).alias("roc_auc"),
            F.when(defined, steps / all_pos).alias("pr_auc"),
        )
    return (
        sums.withColumns(rates())
        .withColumn("confusion_matrix", confusion_matrix())
        .select(*by, "n", *CELLS, *METRICS, "confusion_matrix")
    )
