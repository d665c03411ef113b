"""Exact, repeatable samples and stratified splits.

Rows are ordered by an MD5 hash of seed and key, and the k smallest are taken.
Rather than rank rows, we look for the k-th smallest hash: histograms of ever
longer hash prefixes close in on it until few rows are left.  The sample is
then a plain filter ``hash <= cut`` - narrow, without shuffle, and the same rows
for any partitioning of the input.

Rows that share a key follow each other by a hash of all their columns.  Only
copies that agree in every column can meet at the cut; as they are the same row,
one of them is written out as often as it is wanted on either side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlgauge.session import materialize

SEED = 42

_DIGITS = 4  # hex digits per histogram: 65,536 buckets
_FULL = 48  # hex digits: an MD5 hash of the key and 64 bits of the whole row
_SMALL = 10_000  # rows per stratum that one aggregate may hold
_LOCAL = 100_000  # strata that may be broadcast
MAX_CLASSES = 100_000  # a column with more values is no class label
_MARGIN = 6  # standard deviations above the wanted rows
_NONE, _ALL = "", "~"  # below and above every hex text


def hash_order(seed: int, keys: Sequence[str]) -> Column:
    """The hash rows are ordered by."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _as_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _keyed(df: DataFrame, keys: list[str], stratum: str | None, seed: int) -> DataFrame:
    group = F.lit("") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))
    plain = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    whole = F.lpad(F.lower(F.hex(F.xxhash64(*plain))), 16, "0")
    return df.withColumns({"_h": F.concat(hash_order(seed, keys), whole), "_s": group})


def _with_strata(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Join per-stratum values; their number is known, so the hint is safe."""
    local = df.sparkSession.createDataFrame(rows, f"_s string, {columns}")
    return df.join(F.broadcast(local) if len(rows) <= _LOCAL else local, "_s")


def _prefix_counts(keyed: DataFrame, digits: int) -> DataFrame:
    return keyed.groupBy("_s", F.substring("_h", 1, digits).alias("_p")).agg(F.count("*").alias("_n"))


def _boundary(counts: DataFrame, wanted: dict[str, int]) -> dict[str, tuple[str, int, int]]:
    """Per stratum: the prefix holding the wanted-th row, rows before it, rows in it."""
    ordered = Window.partitionBy("_s").orderBy("_p")
    running = _with_strata(counts, list(wanted.items()), "_k bigint").withColumn(
        "_upto", F.sum("_n").over(ordered)
    )
    hit = running.filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
    return {r["_s"]: (r["_p"], r["_upto"] - r["_n"], r["_n"]) for r in hit.collect()}


def _cuts(keyed: DataFrame, counts: DataFrame, wanted: dict[str, int]) -> dict[str, tuple[str, int, int]]:
    """Per stratum the wanted-th smallest hash, how many of its rows are wanted, and how many there are."""
    digits, left = _DIGITS, dict(wanted)
    done: dict[str, tuple[str, int, int]] = {}
    while left:
        found = _boundary(counts, left)
        left = {s: left[s] - before for s, (_, before, _) in found.items()}
        ready = {s for s, (_, _, n) in found.items() if n <= _SMALL or digits >= _FULL}
        done.update({s: (found[s][0], left[s], found[s][2]) for s in ready})
        left = {s: k for s, k in left.items() if s not in ready}
        if left:
            digits += _DIGITS
            open_rows = [(s, found[s][0]) for s in left]
            inside = _with_strata(keyed, open_rows, "_q string").filter(F.startswith("_h", "_q"))
            counts = _prefix_counts(inside, digits)
    rows = [(s, prefix, k) for s, (prefix, k, _) in done.items() if len(prefix) < _FULL]
    cuts = {s: cut for s, cut in done.items() if len(cut[0]) >= _FULL}
    if rows:
        near = _with_strata(keyed, rows, "_q string, _k bigint").filter(F.startswith("_h", "_q"))
        ranked = near.groupBy("_s", "_k").agg(F.array_sort(F.collect_list("_h")).alias("_hs"))
        picked = ranked.withColumn("cut", F.element_at("_hs", F.col("_k").cast("int"))).select(
            "_s",
            "cut",
            (F.col("_k") - F.size(F.filter("_hs", lambda h: h < F.col("cut")))).alias("take"),
            F.size(F.filter("_hs", lambda h: h == F.col("cut"))).alias("have"),
        )
        cuts.update({r["_s"]: (r["cut"], r["take"], r["have"]) for r in picked.collect()})
    return cuts


def _copies(keyed: DataFrame, cuts: dict[str, tuple[str, int, int]], side: int) -> DataFrame:
    """Copies of the rows at the cuts: those wanted (side 0) or those left over (side 1)."""
    rows = [(s, cut, take if side == 0 else have - take) for s, (cut, take, have) in cuts.items()]
    at = _with_strata(keyed, rows, "_cut string, _n bigint").filter("_h = _cut and _n > 0")
    one = at.groupBy("_s").agg(F.first(F.struct(*[c for c in at.columns if c != "_s"])).alias("_r"))
    return one.select("_r.*", F.explode(F.array_repeat(F.lit(1), F.col("_r._n").cast("int"))))


def exact_sample(df: DataFrame, size: int, key: str | Sequence[str] = "url", seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows without replacement; ``df`` itself if it is not larger.

    Runs jobs when called; give it a stored table, whose rows are counted from its files.
    One scan stores the rows below a hash that about ``size`` rows lie below, with a
    margin; the exact cut is found among these.  Only if hot keys make them too few is
    the cut looked for in the whole table.  Either way the rows are the same.
    """
    if size < 0:
        raise ValueError(f"negative sample size: {size}")
    total = df.count()
    if total <= size:
        return df
    keys = _as_list(key)
    share = (size + _MARGIN * math.sqrt(size) + 100) / total
    if share < 0.5:
        below = f"{int(share * 16**8):08x}"
        near = materialize(_keyed(df, keys, None, seed).filter(F.substring("_h", 1, 8) < below).select(*df.columns))
        if near.count() >= size:
            return _cut_sample(near, size, keys, seed)
    return _cut_sample(df, size, keys, seed)


def _cut_sample(df: DataFrame, size: int, keys: list[str], seed: int) -> DataFrame:
    keyed = _keyed(df, keys, None, seed)
    counts = _prefix_counts(keyed, _DIGITS).persist()
    try:
        cuts = _cuts(keyed, counts, {"": size}) if size else {"": (_NONE, 0, 0)}
    finally:
        counts.unpersist()
    cut, take, have = cuts[""]
    if take == have:
        return keyed.filter(F.col("_h") <= cut).select(*df.columns)
    return keyed.filter(F.col("_h") < cut).select(*df.columns).union(_copies(keyed, cuts, 0).select(*df.columns))


def class_quotas(totals: dict[str, int], size: int) -> dict[str, int]:
    """Rows per class that add up to ``size``: floors, then the largest remainders.

    Equal remainders go to the smaller label.
    """
    everything = sum(totals.values())
    quota = {s: size * n // everything for s, n in totals.items()}
    by_remainder = sorted(totals, key=lambda s: (-(size * totals[s] % everything), s))
    for s in by_remainder[: size - sum(quota.values())]:
        quota[s] += 1
    return quota


def mark_split(
    df: DataFrame,
    fraction: float = 0.8,
    label: str = "label",
    key: str | Sequence[str] = "url",
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` (``train`` or ``test``), with exact sizes and the class shares kept.

    Runs jobs when called; give it a stored table.  Storing the result by
    ``split`` reads that table once for both parts.
    """
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1: {fraction}")
    keyed = _keyed(df, _as_list(key), label, seed)
    counts = _prefix_counts(keyed, _DIGITS).persist()
    try:
        sizes = counts.groupBy("_s").agg(F.sum("_n").alias("n")).limit(MAX_CLASSES + 1).collect()
        if len(sizes) > MAX_CLASSES:
            raise ValueError(f"{label} has more than {MAX_CLASSES} values, so it is no class label")
        totals = {r["_s"]: r["n"] for r in sizes}
        if not totals or min(totals.values()) < 2:
            raise ValueError(f"every class needs at least two rows to be split: {totals}")
        everything = sum(totals.values())
        size = math.floor(fraction * everything)
        if min(size, everything - size) < len(totals):
            raise ValueError(f"too few rows ({everything}) to split {len(totals)} classes")
        quota = class_quotas(totals, size)
        cuts = {s: (_NONE if k == 0 else _ALL, 0, 0) for s, k in quota.items()}
        cuts.update(_cuts(keyed, counts, {s: k for s, k in quota.items() if 0 < k < totals[s]}))
    finally:
        counts.unpersist()
    marked = _with_strata(keyed, [(s, cut) for s, (cut, _, _) in cuts.items()], "_cut string")
    split = F.when(F.col("_h") <= F.col("_cut"), "train").otherwise("test")
    divided = {s: cut for s, cut in cuts.items() if cut[1] < cut[2]}
    if not divided:
        return marked.select(*df.columns, split.alias("split"))
    whole = marked.filter((F.col("_h") != F.col("_cut")) | ~F.col("_s").isin(*divided))
    parts = [_copies(keyed, divided, side).select(*df.columns, F.lit(name).alias("split")) for side, name in enumerate(("train", "test"))]
    return whole.select(*df.columns, split.alias("split")).union(parts[0]).union(parts[1])


def stratified_split(df: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` of :func:`mark_split`, which takes the same arguments."""
    marked = mark_split(df, *args, **options)
    train, test = (marked.filter(F.col("split") == name).drop("split") for name in ("train", "test"))
    return train, test
