"""Versioned model folders ``run_YYYYMMDD_HHMMSS`` and the newest usable one."""

from __future__ import annotations

from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.operators.results import unless_empty
from urlgauge.sources.readers import path_exists

RUN_FORMAT = "%Y%m%d_%H%M%S"
RUN_SCHEMA = "run_id string, path string, valid boolean"
CLAIMS = "_claims"  # a file for each run name that was ever given out
COMPLETE = "_COMPLETE"  # written when all stages of a saved model are


def run_id(ts: Column) -> Column:
    """Run name of a timestamp; names sort in time order."""
    return F.concat(F.lit("run_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def create_if_absent(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already.  Of several callers at once one gets True.

    Distributed file systems decide that in one call.  Hadoop's local one looks first
    and writes then, so Java's own call is taken there.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(file.getParent())
    if system.getUri().getScheme() == "file":
        return spark._jvm.java.io.File(file.toUri().getPath()).createNewFile()
    try:
        system.create(file, False).close()
    except Py4JJavaError as error:
        if path_exists(spark, path):
            return False
        raise error
    return True


def save_run(model: PipelineModel, root: str, now: datetime | None = None) -> str:
    """Save a fitted pipeline under a new run folder and return its path.

    A name is claimed by creating a file that nobody else has created, so savers of
    one second never meet in a folder; the later ones get a number.  The folder is marked as complete
    after all stages are written, so readers never take up half a model.
    """
    spark = SparkSession.active()
    name = f"run_{(now or datetime.now()).strftime(RUN_FORMAT)}"
    run, number = name, 1
    while path_exists(spark, f"{root}/{run}") or not create_if_absent(spark, f"{root}/{CLAIMS}/{run}"):
        number += 1
        run = f"{name}_{number:04d}"
    path = f"{root}/{run}"
    model.write().save(path)
    create_if_absent(spark, f"{path}/{COMPLETE}")
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """A model folder is usable once it is marked as complete.

    A pipeline's own metadata is committed before its stages, so it proves nothing.
    """
    return path_exists(spark, f"{path}/{COMPLETE}")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, path, valid`` for every run folder under ``root``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run_*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath().toString() for s in system.globStatus(pattern) or [] if s.isDirectory()]
    rows = [(path.rsplit("/", 1)[-1], path, is_complete(spark, path)) for path in folders]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def latest_valid(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The newest valid run (per group): one hash aggregate, no sort."""
    return runs.filter("valid").groupBy(*by).agg(
        F.max("run_id").alias("run_id"), F.max_by("path", "run_id").alias("path")
    )


def recorded_path(payloads: DataFrame, source_file: str) -> str | None:
    """The model folder a stored metrics file names, if any."""
    meta = F.get_json_object("payload", "$.meta")
    named = F.coalesce(
        unless_empty(F.get_json_object(meta, "$.bert_dir")), F.get_json_object(meta, "$.bert_model_dir")
    )
    row = payloads.filter(F.col("source_file") == source_file).select(named.alias("path")).first()
    return row["path"] if row is not None else None


def find_model(
    spark: SparkSession, root: str, override: str | None = None, recorded: str | None = None
) -> str:
    """Folder to load: an explicit one, the root if it is a model, or the newest run.

    A ``recorded`` folder, as named by stored metrics, is preferred to the newest
    run as long as it is there.
    """
    if override is not None:
        if not path_exists(spark, override):
            raise FileNotFoundError(f"no such model folder: {override}")
        if not is_complete(spark, override):
            raise FileNotFoundError(f"not a complete model: {override}")
        return override
    if recorded is not None and is_complete(spark, recorded):
        return recorded
    if not path_exists(spark, root):
        raise FileNotFoundError(f"no such model root: {root}")
    if is_complete(spark, root):
        return root
    newest = latest_valid(list_runs(spark, root)).first()
    if newest is None or newest["path"] is None:
        raise FileNotFoundError(f"no complete run_* model under {root}")
    return newest["path"]


def load_model(spark: SparkSession, root: str, override: str | None = None) -> PipelineModel:
    return PipelineModel.load(find_model(spark, root, override))
