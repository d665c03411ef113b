"""Keep-first de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def packed(df: DataFrame, order: Sequence[str]) -> Column | None:
    """Two whole numbers of at most 96 bits together as one number that orders alike; else nothing."""
    kinds = dict(df.dtypes)
    first, second = (_BITS.get(kinds[name], 128) for name in order) if len(order) == 2 else (128, 128)
    if first + second <= 96:
        return F.col(order[0]).cast("decimal(38,0)") * F.lit(Decimal(2**second)) + F.col(order[1])
    return None


def keep_first(
    df: DataFrame, key: str = "url", order: Sequence[str] | str = "ordinal", by_digest: bool = False
) -> DataFrame:
    """One row per ``key``: the one that comes first in ``order``.

    An aggregate rather than a window: copies of a hot key collapse on the map
    side, so no task ever holds them all.  Each payload column carries its own
    ``min_by``; with fixed-width payloads and a numeric order the buffers are
    mutable and Spark picks a hash aggregate over a sort.

    ``by_digest`` is for long keys under one order column that identifies rows: the
    first place of each key's SHA-256 is found by hash, and only the chosen places,
    never the keys, are shuffled.
    """
    order = [order] if isinstance(order, str) else list(order)
    if by_digest:
        digest = F.sha2(F.col(key).cast("binary"), 256)
        first = df.groupBy(F.unhex(digest).alias("_digest")).agg(F.min(order[0]).alias(order[0]))
        return df.join(first.select(order[0]), order[0], "left_semi").select(*df.columns)
    whole = packed(df, order)
    if whole is not None:
        payload = [name for name in df.columns if name != key]
        picked = df.withColumn("_at", whole).groupBy(key).agg(*[F.min_by(name, "_at").alias(name) for name in payload])
        return picked.select(*df.columns)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    payload = [name for name in df.columns if name != key and name not in order]
    picked = df.groupBy(key).agg(
        F.min(position).alias("_first"), *[F.min_by(name, position).alias(name) for name in payload]
    )
    if len(order) == 1:
        places = [F.col("_first").alias(order[0])]
    else:
        places = [F.col(f"_first.{name}").alias(name) for name in order]
    return picked.select(key, *payload, *places).select(*df.columns)
