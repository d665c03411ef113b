"""Set relations of tables that are stored by key, without moving their rows.

A table written by :func:`store_by_key` is dealt over buckets by its key and sorted in them.  Two tables with the same
number of buckets can be grouped and joined bucket by bucket, so none of the operators here shuffles a stored table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.operators.dedup import keep_first
from urlgauge.session import work_folder

BUCKETS = 64


def store_by_key(df: DataFrame, key: str = "url", buckets: int = BUCKETS, path: str | None = None, name: str | None = None) -> DataFrame:
    """Write ``df`` in buckets of ``key``, sorted by it, as a table of the session's catalog, and read it back.

    It lands in the shared folder for intermediates unless ``path`` says otherwise.  One shuffle now saves those of
    all later readers.
    """
    spark = df.sparkSession
    name = name or f"by_key_{uuid.uuid4().hex}"
    path = path or f"{work_folder(spark)}/{name}"
    # a task for each bucket, so that there is one file in each
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def stored_new(feed: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``feed`` whose key is not in ``known``."""
    return feed.join(known.select(key), key, "left_anti")


def stored_common(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys found on both sides; a missing key is none."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def stored_union_first(first: DataFrame, second: DataFrame, key: str = "url", order: str = "ordinal") -> DataFrame:
    """One row per key of both tables, the first by ``order``; rows of ``first`` win.

    Both are cut down to one row per key in place, and meet in a full join instead of a union, which would have to be
    dealt anew.  Rows without a key, which no cleaned table has, are left out.
    """
    columns = first.columns
    sides = [
        keep_first(side.where(F.col(key).isNotNull()), key, order).select(F.col(key).alias(f"_{n}"), F.struct(*columns).alias(f"_row{n}"))
        for n, side in enumerate((first, second.select(columns)))
    ]
    both = sides[0].join(sides[1], F.col("_0") == F.col("_1"), "full")
    return both.select(F.coalesce("_row0", "_row1").alias("_row")).select("_row.*")
