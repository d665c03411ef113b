"""Set relations between URL tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.operators.dedup import keep_first
from urlgauge.session import BROADCAST_LIMIT, broadcast_if_small, materialize, text_bytes

#: Bits of a key filter at most: 64 MB.
FILTER_BITS = 1 << 29


def common_urls(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys found on both sides.

    One aggregate over both inputs instead of a join: copies of a hot key are
    combined before the shuffle, so it cannot swamp a task.
    """
    sides = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    return sides.groupBy(key).agg(F.bit_or("side").alias("side")).filter("side = 3").select(key)


def overlap_count(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """``overlap``: how many distinct keys both sides share (0 means no leakage)."""
    return common_urls(left, right, key).agg(F.count("*").alias("overlap"))


def filter_bits(keys: int) -> int:
    """Bits of the key filter for so many keys: 20 for each, so that under one in a hundred others passes, up to a limit.

    More keys than the limit has room for make the filter pass more, never less.
    """
    return min(max(1 << (20 * max(keys, 1) - 1).bit_length(), 1 << 16), FILTER_BITS)


def _bit_places(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt), key), F.lit(bits)) + 1 for salt in (0, 1)]


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``_part, _bits``: a Bloom filter of the keys as bitmaps of 32,768 bits, at most ``bits / 8`` bytes together."""
    places = keys.select(F.explode(F.array(*_bit_places(key, bits))).alias("_place"))
    return places.groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )


def maybe_among(df: DataFrame, filter_: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows whose key the filter may hold: all that it holds, and few others.  Map side, as the filter's size is bounded."""
    out = df
    for place in _bit_places(key, bits):
        spot = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = out.withColumn("_part", F.bitmap_bucket_number(place)).join(F.broadcast(filter_), "_part")
        out = held.filter(F.getbit(byte, (spot % 8).cast("int")) == 1).select(*df.columns)
    return out


def only_new(feed: DataFrame, known: DataFrame, key: str = "url", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Rows of ``feed`` whose key is not in ``known``.

    The feed is the small side, yet an anti join can only broadcast its right
    side.  So the big table is first cut down to the keys the feed asks about,
    with those broadcast when their measured size allows, and the anti join runs
    on what is left; the big table is then never shuffled whole.  A feed too large for
    that is broadcast as a Bloom filter of bounded size, and only the keys that pass it
    are shuffled.  Both small tables are stored, which makes sure that either input is read only once for them; this
    happens when the function is called.
    """
    asked = materialize(feed.select(key).distinct())
    keys = known.select(key)
    if text_bytes(asked, key) <= limit:
        hits = keys.join(F.broadcast(asked), key, "left_semi").distinct()
    else:
        bits = filter_bits(asked.count())
        maybe = maybe_among(keys, materialize(key_filter(asked, key, bits)), key, bits)
        # Copies go before the shuffle the join needs anyway, so none can be hot.
        hits = maybe.distinct().join(asked, key, "left_semi")
    return feed.join(broadcast_if_small(materialize(hits), key, limit), key, "left_anti")


def union_keep_first(first: DataFrame, second: DataFrame, key: str = "url", order: str = "ordinal") -> DataFrame:
    """UNION ALL of two tables, then one row per key; rows of ``first`` win.

    Places in files, which fill a decimal number, stay one number: those of ``first``
    are moved below zero, so Spark can go on aggregating by hash.
    """
    if dict(first.dtypes)[order] == dict(second.dtypes)[order] == "decimal(38,0)":
        moved = first.withColumn("_place", F.col(order) - F.lit(Decimal(10**38 - 1)))
        both = moved.unionByName(second.withColumn("_place", F.col(order))).withColumn("_place", F.col("_place").cast("decimal(38,0)"))
        return keep_first(both, key, "_place").drop("_place")
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return keep_first(both, key, ["_side", order]).drop("_side")
