"""Sinks.  Parquet between jobs; CSV, JSON and Markdown for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_splits(train: DataFrame, test: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """``split=train`` and ``split=test`` folders, so a reader prunes by ``split``.

    Two plain writes: no union, no shuffle, nothing scanned twice.
    """
    train.write.mode(mode).parquet(f"{folder}/split=train")
    test.write.mode(mode).parquet(f"{folder}/split=test")


def write_marked(marked: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Store a table by its ``split`` column: both parts from one pass over it."""
    marked.write.mode(mode).partitionBy("split").parquet(folder)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_error_slices(scored: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One folder per error class; reading a single class touches only its files."""
    scored.write.mode(mode).partitionBy("error_type").parquet(folder)


def read_error_slice(spark, folder: str, error_type: str | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    return df if error_type is None else df.filter(F.col("error_type") == error_type)


def write_payload(payload: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a one-row ``payload`` of JSON text under the name of a metrics file."""
    payload.select("payload").coalesce(1).write.mode(mode).text(path)


def _cell(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = F.format_string("%.4f", value)
    return F.coalesce(F.when(F.col(field.name).isNotNull(), value.cast("string")), F.lit(""))


def markdown_lines(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """``line_no, line``: a pipe table with four decimals for floating-point cells.

    For report tables (one row per model), so ordering them in one task is fine.
    """
    from pyspark.sql import Window

    names = df.columns
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(f) for f in df.schema.fields]), F.lit(" |"))
    body = df.select(
        (F.row_number().over(Window.orderBy(*order_by)) + 2).cast("int").alias("line_no"), cells.alias("line")
    )
    head = [(1, f"| {' | '.join(names)} |"), (2, f"|{'|'.join(' --- ' for _ in names)}|")]
    return df.sparkSession.createDataFrame(head, "line_no int, line string").unionByName(body)


def write_summary(summary: DataFrame, folder: str, order_by: list[Column], mode: str = "errorifexists") -> None:
    """Summary table as CSV and as Markdown."""
    write_csv(summary.orderBy(*order_by).coalesce(1), f"{folder}/summary_csv", mode)
    lines = markdown_lines(summary, order_by).orderBy("line_no").coalesce(1)
    lines.select("line").write.mode(mode).text(f"{folder}/summary_md")
