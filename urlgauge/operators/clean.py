"""From raw rows to the canonical ``url, label, source`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from urlgauge.functions.text import binary_label, clean_url
from urlgauge.operators.dedup import keep_first
from urlgauge.session import materialize

# Names of the two kinds of source in stored tables.
LABELLED_SOURCE = "github"
FEED_SOURCE = "openphish"

CLEANING = [("url_filter", "raw", "with_url"), ("label_filter", "with_url", "with_label"), ("dedup", "with_label", "distinct")]


def clean_labelled(raw: DataFrame) -> DataFrame:
    """Clean URLs and map labels; unusable values become NULL, no row is dropped yet."""
    return raw.withColumns({"url": clean_url(F.col("url")), "label": binary_label(F.col("label"))})


def labelled_urls(raw: DataFrame, source: str = LABELLED_SOURCE, order: str = "ordinal") -> DataFrame:
    """``url, label, <order>, source``: clean, labelled, first of each URL.

    Rows without a usable label go before de-duplication, so they can never be
    the "first" copy that wins.
    """
    return _labelled(clean_labelled(raw), source, order)


def _labelled(cleaned: DataFrame, source: str, order: str) -> DataFrame:
    usable = cleaned.na.drop(subset=["url", "label"])
    return keep_first(usable.select("url", "label", order), "url", order).withColumn("source", F.lit(source))


def feed_urls(raw: DataFrame, source: str = FEED_SOURCE, order: str = "ordinal") -> DataFrame:
    """A feed as positives: ``url, label = 1, <order>, source``."""
    usable = raw.withColumn("url", clean_url(F.col("url"))).na.drop(subset=["url"])
    return keep_first(usable.select("url", order), "url", order).select(
        "url", F.lit(1).alias("label"), order, F.lit(source).alias("source")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the size of each table, from one aggregate over all of them."""
    named = [table.select(F.lit(name).alias("name")) for name, table in tables.items()]
    together = named[0]
    for table in named[1:]:
        together = together.unionByName(table)
    return together.agg(*[F.count_if(F.col("name") == name).alias(name) for name in tables])


def audit_table(counts: DataFrame, stages: list[tuple[str, str, str]]) -> DataFrame:
    """One-row counts -> ``stage, rows_before, rows_after, removed`` rows."""
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(stage).alias("stage"),
                    F.col(before).alias("rows_before"),
                    F.col(after).alias("rows_after"),
                    (F.col(before) - F.col(after)).alias("removed"),
                )
                for stage, before, after in stages
            ]
        )
    )
    return counts.select(rows.alias("_row")).select("_row.*")


def audit_labelled(raw: DataFrame) -> DataFrame:
    """Rows before and after each cleaning step, all from one pass over ``raw``."""
    usable = F.col("url").isNotNull() & F.col("label").isNotNull()
    per_url = (
        clean_labelled(raw)
        .select(F.when(usable, F.col("url")).alias("key"), F.col("url").isNotNull().alias("has_url"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.count_if("has_url").alias("n_url"))
    )
    labelled = F.col("key").isNotNull()
    counts = per_url.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("n_url"), F.lit(0)).alias("with_url"),
        F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0)).alias("with_label"),
        F.count_if(labelled).alias("distinct"),
    )
    return audit_table(counts, CLEANING)


def stored_labelled(raw: DataFrame, source: str = LABELLED_SOURCE, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """:func:`labelled_urls`, stored, and what :func:`audit_labelled` says of it.

    The rows are counted on their way to the table, so ``raw`` is read once; the
    table's own size comes from its files.  Runs the job that writes the table.
    """
    seen = Observation()
    usable = F.col("url").isNotNull() & F.col("label").isNotNull()
    counts = [F.count("*").alias("raw"), F.count_if(F.col("url").isNotNull()).alias("with_url"), F.count_if(usable).alias("with_label")]
    labelled = materialize(_labelled(clean_labelled(raw).observe(seen, *counts), source, order))
    distinct = labelled.count()
    # a table that is known to have no rows is not run, so nothing is seen of it
    empty = not distinct and raw.isEmpty()
    found = dict.fromkeys(("raw", "with_url", "with_label"), 0) if empty else seen.get
    sizes = [F.lit(value).cast("bigint").alias(name) for name, value in {**found, "distinct": distinct}.items()]
    return labelled, audit_table(raw.sparkSession.range(1).select(*sizes), CLEANING)
