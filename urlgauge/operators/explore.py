"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlgauge.functions.url import exploration_domain
from urlgauge.operators.ranking import ONE_TASK, value_bounds, with_running_totals
from urlgauge.session import materialize

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``<column>, count`` by falling count; NULLs are left out."""
    counts = df.na.drop(subset=[column]).groupBy(column).count()
    return counts.orderBy(F.col("count").desc(), column)


def value_shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of each value (per group); without a group the rows are counted when called."""
    present = df.na.drop(subset=[column])
    counts = present.groupBy(*by, column).count()
    if not by:
        # one number for all, so that no task has to hold every value
        return counts.select(column, (F.col("count") / F.lit(present.count())).alias("share"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy(*by))
    return counts.select(*by, column, share.alias("share"))


def describe_column(
    df: DataFrame, column: str, by: Sequence[str] = (), one_task: int = ONE_TASK
) -> DataFrame:
    """count, mean, std, min, exact quartiles (interpolated) and max (per group).

    Quartiles come from running counts over distinct values, so neither a hot
    value nor a column of distinct values piles up in one task.
    """
    by = list(by)
    usable = df.na.drop(subset=[column]).select(*by, F.col(column).alias("_x"))
    folded = materialize(
        usable.groupBy(*by, "_x")
        .agg(F.count("*").alias("_n"))
        .withColumn("_nx", F.col("_n") * F.col("_x").cast("double"))
    )
    bounds = value_bounds(folded, "_x", one_task)
    ranked = with_running_totals(folded, "_x", ["_n", "_nx"], bounds, by)

    x, total = F.col("_x").cast("double"), F.col("all__n")
    mean = F.col("all__nx") / total
    deviation = F.sum(F.col("_n") * (x - mean) * (x - mean))
    edges = {
        f"_{edge}_{name}": F.min(F.when(F.col("cum__n") > rank(F.lit(q) * (total - 1)), x))
        for name, q in QUARTILES.items()
        for edge, rank in (("lo", F.floor), ("hi", F.ceil))
    }
    count = F.coalesce(F.sum("_n"), F.lit(0))
    summed = ranked.groupBy(*by).agg(
        count.alias("count"),
        (F.sum("_nx") / F.sum("_n")).alias("mean"),
        F.when(count > 1, F.sqrt(deviation / (count - 1))).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        *[edge.alias(name) for name, edge in edges.items()],
    )
    quartiles = []
    for name, q in QUARTILES.items():
        place = F.lit(q) * (F.col("count") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        quartiles.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return summed.select(*by, "count", "mean", "std", "min", *quartiles, "max")


def describe_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, mean, std, min, max``, one row per column, from one aggregate."""
    parts = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(
        *[
            F.struct(*[fn(name).cast("double").alias(part) for part, fn in parts.items()]).alias(name)
            for name in columns
        ]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), f"{n}.*") for n in columns]))
    return wide.select(rows.alias("_row")).select("_row.*")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bin, low, high, count`` of equal-width bins, empty ones included.

    A value belongs to the bin whose computed edges enclose it; the last bin is
    closed on the right.  A column of one value gets a range of width one.  Only
    finite values count: others have no place on a range.
    """
    usable = df.select(F.col(column).cast("double").alias("_x")).filter(F.abs("_x") < float("inf"))
    ends = usable.agg(F.min("_x"), F.max("_x")).first()
    if ends[0] is None:
        low, high = 0.0, 1.0
    else:
        low, high = (ends[0], ends[1]) if ends[0] < ends[1] else (ends[0] - 0.5, ends[1] + 0.5)
    width = (high - low) / bins

    def edge(index):
        return F.when(index == bins, F.lit(high)).otherwise(index * F.lit(width) + F.lit(low))

    guess = F.least(F.floor((F.col("_x") - low) / (high - low) * bins), F.lit(bins - 1))
    placed = (
        usable.withColumn("_g", guess)
        .withColumn("_g", F.col("_g") - (F.col("_x") < edge(F.col("_g"))).cast("int"))
        .withColumn(
            "bin",
            F.col("_g")
            + ((F.col("_x") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1)).cast("int"),
        )
    )
    counts = placed.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def top_domains(df: DataFrame, url: str = "url", rows: int = 20) -> DataFrame:
    """The most frequent hosts; counts are combined before the shuffle."""
    counts = df.groupBy(exploration_domain(F.col(url)).alias("domain")).count()
    return counts.orderBy(F.col("count").desc(), "domain").limit(rows)
