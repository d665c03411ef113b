"""Running totals over a globally ordered value, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ONE_TASK = 1_000_000  # values that may be ordered in a single task; windows spill
MAX_BUCKETS = 2_000
LEAST_ERROR = 1e-4  # of the quantiles, so that a task's summary holds some 10,000 values at most


def value_bounds(df: DataFrame, value: str, one_task: int = ONE_TASK) -> list[float]:
    """Boundaries cutting ``value`` into runs of about equally many rows.

    Empty when a stored table is short enough for one task.  The boundaries steer
    load only: a rough quantile gives the same result as an exact one.
    """
    rows = df.count()
    if rows <= one_task:
        return []
    number = F.col(value).cast("double")
    usable = df.select(F.when(~F.isnan(number), number).alias("v")).na.drop()
    buckets = min(MAX_BUCKETS, -(-rows // one_task))
    cuts = [i / buckets for i in range(1, buckets)]
    return sorted(set(usable.approxQuantile("v", cuts, max(1 / (4 * buckets), LEAST_ERROR))))


def with_running_totals(
    df: DataFrame,
    value: str,
    totals: Sequence[str],
    bounds: Sequence[float],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<name>``, the inclusive running sum of ``name`` along ``value``,
    and ``all_<name>``, its total, within each group.

    ``df`` holds one row per group and value and is read twice, so pass a stored
    table.  Each bucket of values is summed
    up on its own; what precedes a bucket comes from the per-bucket totals, of
    which there are at most ``MAX_BUCKETS`` per group.
    """
    by = list(by)
    direction = (lambda name: F.col(name).desc()) if descending else (lambda name: F.col(name).asc())
    upto_here = (Window.unboundedPreceding, Window.currentRow)
    if not bounds:
        along = Window.partitionBy(*by).orderBy(direction(value)).rowsBetween(*upto_here)
        whole = Window.partitionBy(*by)
        return df.withColumns(
            {
                **{f"cum_{name}": F.sum(name).over(along) for name in totals},
                **{f"all_{name}": F.sum(name).over(whole) for name in totals},
            }
        )

    splits = [float("-inf"), *bounds, float("inf")]
    bucketed = (
        Bucketizer(splits=splits, inputCol="_v", outputCol="_bucket", handleInvalid="keep")
        .transform(df.withColumn("_v", F.col(value).cast("double")))
        .withColumn("_bucket", F.col("_bucket").cast("int"))
        .drop("_v")
    )
    key = [*by, "_bucket"]
    along = Window.partitionBy(*key).orderBy(direction(value)).rowsBetween(*upto_here)
    local = bucketed.withColumns({f"_in_{name}": F.sum(name).over(along) for name in totals})
    before = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*key)
        .agg(*[F.sum(name).alias(name) for name in totals])
        .select(
            *[F.col(name).alias(f"_k_{name}") for name in key],
            *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
            *[F.sum(name).over(Window.partitionBy(*by)).alias(f"all_{name}") for name in totals],
        )
    )
    same = [F.col(name).eqNullSafe(F.col(f"_k_{name}")) for name in key]
    return local.join(offsets, same).select(
        *df.columns,
        *[(F.col(f"_off_{name}") + F.col(f"_in_{name}")).alias(f"cum_{name}") for name in totals],
        *[f"all_{name}" for name in totals],
    )
