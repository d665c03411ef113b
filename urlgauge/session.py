"""Session helpers: settings, written intermediates, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BROADCAST_LIMIT = 64 * 1024 * 1024


def local_session(app: str, cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    Without a checkpoint folder in ``settings`` it gets one of its own, which is
    removed when Python ends.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if CHECKPOINT_SETTING not in settings:
        folder = tempfile.mkdtemp(prefix="urlgauge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        builder = builder.config(CHECKPOINT_SETTING, folder)
    for name, value in settings.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def work_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    It is the cluster's checkpoint folder.  A local session that was made without
    one, where nothing is shared between machines, gets one until Python ends.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="urlgauge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/urlgauge/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors, and, unlike an RDD
    checkpoint, keeps column pruning and filter push-down for later readers.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> int:
    """Measured in-memory size of one text column, row overhead included."""
    size = df.select(F.sum(F.octet_length(column) + F.lit(64)).alias("size")).first()["size"]
    return size or 0


def broadcast_if_small(df: DataFrame, column: str, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast of a one-text-column table only when it measurably fits.

    A larger table is returned without a hint, so Spark shuffles both sides
    (and splits skewed keys at run time).
    """
    return F.broadcast(df) if text_bytes(df, column) <= limit else df
