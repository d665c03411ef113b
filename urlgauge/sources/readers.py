"""Scans: raw labelled CSV, text feeds, splits, features, metrics files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.contracts import require_columns, require_same_features
from urlgauge.functions.text import LINE_BREAKS, drop_invalid_utf8, strip_whitespace
from urlgauge.session import broadcast_if_small, materialize

# The metrics files a full run leaves behind.
METRICS_FILES = ("ml_results.json", "ngram_results.json", "bert_results.json", "hybrid_results.json")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob names anything, on any Hadoop file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def present_paths(spark: SparkSession, paths: Sequence[str], skip_missing: bool = False) -> list[str]:
    """``paths`` that exist; a missing one is an error unless it may be skipped."""
    found = [path for path in paths if path_exists(spark, path)]
    missing = [path for path in paths if path not in found]
    if missing and not skip_missing:
        raise FileNotFoundError(f"no such input: {', '.join(missing)}")
    return found


POSITION = "decimal(38,0)"


def file_places(spark: SparkSession, path: str) -> DataFrame:
    """``_path, _place``: the files under ``path``, numbered in the order of their paths.

    No file is opened: the paths come from a listing.  They are sorted by ranges over
    all tasks; only the number of paths in each range reaches the driver.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_path"))
    ranges = listed.repartitionByRange("_path").sortWithinPartitions("_path")
    nth = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    ranges = materialize(ranges.select("_path", F.spark_partition_id().alias("_range"), nth.alias("_nth")))
    sizes = sorted((row["_range"], row["count"]) for row in ranges.groupBy("_range").count().collect())
    starts = [(part, sum(size for other, size in sizes if other < part)) for part, _ in sizes]
    # one row for each range, so never more than there are shuffle partitions
    starts = F.broadcast(spark.createDataFrame(starts, "_range int, _start long"))
    return ranges.join(starts, "_range").select("_path", (F.col("_start") + F.col("_nth")).alias("_place"))


def with_file_order(rows: DataFrame, path: str, name: str = "ordinal") -> DataFrame:
    """Add the position of each row in its input files, as one number, and drop what it is made of.

    ``rows`` has ``_file``, ``_block``, ``_row`` and ``_piece``: path, start of the
    file block, row number within the task, and piece of the line.  Row numbers grow
    inside a block, and blocks sort by path and offset, so "first" means file order
    however Spark packs blocks into partitions.  A number, unlike a path, lets Spark
    aggregate by hash.  The numbers of the files are joined, broadcast if their
    measured size allows.
    """
    places = file_places(rows.sparkSession, path)
    digits = F.lit(0).cast(POSITION) + F.col("_place")
    for column, width in (("_block", 13), ("_row", 10), ("_piece", 5)):
        digits = (digits * F.lit(10**width).cast("decimal(14,0)")).cast(POSITION) + F.col(column).cast("decimal(13,0)")
    placed = rows.join(broadcast_if_small(places, "_path"), F.col("_file") == F.col("_path"))
    return placed.withColumn(name, digits.cast(POSITION)).drop("_file", "_block", "_row", "_piece", "_place", "_path")


def _place(piece: Column | None = None) -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)).alias("_row"),
        (F.lit(0) if piece is None else piece).cast("int").alias("_piece"),
    ]


def read_labelled_csv(
    spark: SparkSession,
    path: str,
    url: str = "URL",
    label: str = "Label",
    multi_line: bool = False,
) -> DataFrame:
    """``url, label`` (both text) and ``ordinal``; other columns are never parsed.

    ``multi_line`` allows line ends inside quotes, at the price of files that
    cannot be read by several tasks.
    """
    present_paths(spark, [path])
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )
    require_columns(raw, [url, label], path)
    rows = raw.select(F.col(url).alias("url"), F.col(label).alias("label"), *_place())
    return with_file_order(rows, path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``url, ordinal``: one non-blank line of a text feed per row."""
    present_paths(spark, [path])
    raw = spark.read.text(path)
    lines = raw.select(
        F.posexplode(F.split(drop_invalid_utf8(F.col("value")), LINE_BREAKS)).alias("piece", "line"),
        "_metadata",
    )
    rows = lines.select(strip_whitespace(F.col("line")).alias("url"), *_place(F.col("piece")))
    return with_file_order(rows.filter("url <> ''"), path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A stored split with ``url`` text and ``label`` integer."""
    present_paths(spark, [path])
    df = require_columns(spark.read.parquet(path), ["url", "label"], path)
    return df.withColumns({"url": F.col("url").cast("string"), "label": F.col("label").cast("int")})


def read_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Stored feature tables ``(train, test)`` and their common feature names."""
    stored = read_split(spark, folder)
    require_columns(stored, ["split"], folder)
    train, test = (stored.filter(F.col("split") == name).drop("split") for name in ("train", "test"))
    return train, test, require_same_features(train, test)


def read_metrics(
    spark: SparkSession, folder: str, names: Sequence[str] = METRICS_FILES, skip_missing: bool = True
) -> DataFrame:
    """``source_file, payload``: each metrics file (or folder of one) as JSON text."""
    found = present_paths(spark, [f"{folder}/{name}" for name in names], skip_missing)
    payloads = spark.createDataFrame([], "source_file string, payload string")
    for path in found:
        text = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
        payloads = payloads.unionByName(
            text.select(F.lit(path.rsplit("/", 1)[-1]).alias("source_file"), F.col("value").alias("payload"))
        )
    return payloads


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first few rows, for a look at the columns, each with the table's ``row_count``."""
    return df.limit(rows).withColumn("row_count", F.lit(df.count()).cast("bigint"))
