"""Which documents a model may learn from, and bounded samples of labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(modulus: int, column: str = "doc_id") -> Column:
    """Whether the remainder is 2: rows that no model learns from. A null id is not held out."""
    return F.coalesce(remainder(modulus, column) == 2, F.lit(False))


def label_sample(labelled: DataFrame, label: str, rows: int, modulus: int, kept_out: int = 2) -> DataFrame:
    """doc_id, label and weight of up to `rows` rows of each label that may be learned from, chosen by a hash of the id.

    The weight is how many rows of the label each one stands for. Null labels and ids are left out; of rows that
    repeat an id the smallest label counts. Labels are few by nature.
    """
    known = labelled.where(remainder(modulus) != kept_out).where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    totals = known.groupBy(label).agg(F.count("*").alias("_total"))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # about twice as many rows as wanted go on, so that no label gathers in one task
    near = known.join(F.broadcast(totals), label).where(spot < (2 * rows + 100) / F.col("_total") * (1 << 30))
    order = Window.partitionBy(label).orderBy(spot, "doc_id")
    chosen = near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= rows)
    return chosen.select("doc_id", label, (F.col("_total") / F.least("_total", F.lit(rows))).alias("weight"))
