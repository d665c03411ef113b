"""Consolidating stored metrics of several runs into one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.operators.metrics import METRICS

# Column order of the summary, and what each metrics file holds:
# several models or a single one, and the name of a model that has none.
META_COLUMNS = (
    "model",
    "source_file",
    "n_train",
    "n_test",
    "pos_rate_train",
    "pos_rate_test",
    "device",
    "bert_dir",
)
SUMMARY_COLUMNS = META_COLUMNS + METRICS
COMPARISON_COLUMNS = ("model", "accuracy", "f1", "roc_auc", "pr_auc")
SEVERAL_MODELS_FILES = {"ml_results.json": "ML_Model"}
SINGLE_MODEL_FILES = {
    "ngram_results.json": "CharTFIDF(2-3)+LogReg",
    "bert_results.json": "DistilBERT",
    "hybrid_results.json": "Hybrid(LGBM+BERT)",
}
# Spellings of each meta field, the preferred one first.
META_KEYS = {
    "n_train": ("n_train_sampled", "n_train", "train_size"),
    "n_test": ("n_test_sampled", "n_test", "test_size"),
    "pos_rate_train": ("positive_rate_train", "pos_rate_train"),
    "pos_rate_test": ("positive_rate_test", "pos_rate_test"),
    "device": ("device",),
    "bert_dir": ("bert_dir", "bert_model_dir"),
}

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|[nN]a[nN])\s*$"


def safe_double(text: Column) -> Column:
    """A number, or NULL for anything that does not spell one."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def unless_empty(text: Column) -> Column:
    """NULL for values that count as absent: zero, false and empty text."""
    absent = F.coalesce(safe_double(text) == 0, F.lit(False)) | text.isin("", "false", "[]", "{}")
    return F.when(~absent, text)


def _field(document: Column, name: str) -> Column:
    return F.get_json_object(document, f"$.{name}")


def first_present(meta: Column, names: Sequence[str]) -> Column:
    """First value that is not empty; the last spelling is taken as it is."""
    found = [unless_empty(_field(meta, name)) for name in names[:-1]]
    return F.coalesce(*found, _field(meta, names[-1]))


def _record(model: Column, metrics: Column, meta: Column) -> list[Column]:
    values = {name: first_present(meta, keys) for name, keys in META_KEYS.items()}
    return [
        model.alias("model"),
        F.col("source_file"),
        *[safe_double(values[name]).cast("bigint").alias(name) for name in ("n_train", "n_test")],
        *[safe_double(values[name]).alias(name) for name in ("pos_rate_train", "pos_rate_test")],
        values["device"].alias("device"),
        values["bert_dir"].alias("bert_dir"),
        *[safe_double(_field(metrics, name)).alias(name) for name in METRICS],
    ]


def _named(column: Column, names: Mapping[str, str]) -> Column:
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.element_at(F.create_map(*pairs), column)


def several_models(payloads: DataFrame, default_name: Column) -> DataFrame:
    """A row per model of ``{meta, results: [...]}`` or of a bare list.

    Entries that are not objects are passed over.
    """
    bare = F.ltrim(F.col("payload")).startswith("[")
    listed = F.when(bare, F.col("payload")).otherwise(_field(F.col("payload"), "results"))
    items = F.from_json(F.when(F.ltrim(listed).startswith("["), listed), "array<string>")
    rows = payloads.select(
        "source_file",
        F.when(~bare, _field(F.col("payload"), "meta")).alias("_meta"),
        default_name.alias("_default"),
        F.explode(items).alias("_item"),
    ).filter(F.ltrim("_item").startswith("{"))
    name = F.coalesce(_field(F.col("_item"), "model"), F.col("_default"))
    return rows.select(*_record(name, F.col("_item"), F.col("_meta")))


def single_model(payloads: DataFrame, default_name: Column) -> DataFrame:
    """One row for ``{meta, metrics}``, or for metrics at the top level."""
    inner = _field(F.col("payload"), "metrics")
    rows = payloads.filter(F.ltrim("payload").startswith("{")).select(
        "source_file",
        _field(F.col("payload"), "meta").alias("_meta"),
        F.when(F.ltrim(inner).startswith("{"), inner).alias("_inner"),
        F.col("payload").alias("_payload"),
        default_name.alias("_default"),
    )
    given = F.when(F.col("_inner").isNotNull(), unless_empty(_field(F.col("_meta"), "model_name")))
    name = F.coalesce(given, F.col("_default"))
    return rows.select(*_record(name, F.coalesce("_inner", "_payload"), F.col("_meta")))


def known_columns(df: DataFrame, order: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """The columns of ``order`` that are there, in that order."""
    return df.select(*[name for name in order if name in df.columns])


def summary_order() -> list[Column]:
    return [F.desc_nulls_last("f1"), F.asc("model"), F.asc("source_file")]


def summarize(
    payloads: DataFrame,
    several: Mapping[str, str] = SEVERAL_MODELS_FILES,
    single: Mapping[str, str] = SINGLE_MODEL_FILES,
) -> DataFrame:
    """``source_file, payload`` -> one row per model, best F1 first."""
    file = F.col("source_file")
    rows = several_models(payloads.filter(file.isin(*several)), _named(file, several)).unionByName(
        single_model(payloads.filter(file.isin(*single)), _named(file, single)), allowMissingColumns=True
    )
    return known_columns(rows).orderBy(*summary_order())


def require_rows(summary: DataFrame) -> DataFrame:
    """The summary, or an error when no metrics could be found at all."""
    if summary.isEmpty():
        raise RuntimeError("no metrics files found, or none of them could be read")
    return summary


def comparison(summary: DataFrame) -> DataFrame:
    """The short table for comparing models."""
    return known_columns(summary, COMPARISON_COLUMNS)


_KEEP_NULLS = {"ignoreNullFields": "false"}


def single_payload(metrics: DataFrame, meta: Column) -> DataFrame:
    """``payload``: ``{meta, metrics}`` per row."""
    body = F.struct(meta.alias("meta"), F.struct(*METRICS, "confusion_matrix").alias("metrics"))
    return metrics.select(F.to_json(body, _KEEP_NULLS).alias("payload"))


def several_payload(metrics: DataFrame, meta: Column, *extra: Column) -> DataFrame:
    """``payload``: ``{meta, results}`` of a table with one row per ``model``."""
    entry = F.struct("model", *METRICS, "confusion_matrix", *extra)
    by_name = lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0)
    results = metrics.agg(F.array_sort(F.collect_list(entry), by_name).alias("results"))
    return results.select(F.to_json(F.struct(meta.alias("meta"), "results"), _KEEP_NULLS).alias("payload"))
