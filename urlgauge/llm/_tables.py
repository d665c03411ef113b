"""Joins of whole documents with lists that may be small, and connected components of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.session import materialize

#: A stored list is broadcast only while its rows, at this many bytes each, stay below the limit.
ROW_BYTES = 64
LIST_BYTES = 32 << 20
#: Links, at 16 bytes each, that one task may put together; more are joined by stars over all tasks.
TASK_LINKS = 1 << 20


def small_list(df: DataFrame, limit: int = LIST_BYTES) -> DataFrame:
    """A stored list of short rows, marked for broadcast if its counted size is within the limit."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= limit else df


def row_key() -> "F.Column":
    """A key of a document row that equal rows share and that no lost executor changes."""
    return F.xxhash64("doc_id", "text")


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of each node of the links (a, b), stored: the smallest node reachable.

    Up to `task_links` counted links fit in one small task. More take large and small stars by turns (Kiveris et
    al. 2014): every round hangs each node's neighbours on the smallest one, by a partially aggregated minimum and
    a join, so no node's neighbours are gathered in one task; the links are stored in each round, and rounds grow
    with the logarithm of the longest chain. Both ways give the same rows.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if edges.count() <= task_links:
        return materialize(edges.coalesce(1).mapInArrow(_put_together, "node bigint, component bigint"))
    return materialize(_stars(edges))


def _put_together(batches):
    """Components of all links of a task, by hooking roots on smaller ones and halving the ways to them."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([x for side in zip(*parts, strict=True) for x in side]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.record_batch([nodes, nodes[root]], names=["node", "component"])


def _stars(edges: DataFrame) -> DataFrame:
    state = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = materialize(small.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        found = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if found == state:
            break
        state = found
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a"), F.col("a"))).distinct()
