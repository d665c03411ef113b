"""Near copies by min-max hashing: the smallest and the largest hash under each permutation make a signature.

Both ends of one permutation are unbiased estimates of the same similarity, so a signature needs half the hash
evaluations. Bands of three values find candidates; a link counts only once the full sets of word shingles of
both documents confirm it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._tables import components, small_list
from urlgauge.session import materialize

SHINGLE = 5
PERCENT = 75
#: At the similarity of 0.75 a pair shares no band with probability (1 - 0.75 ** 3) ** 24, about 2 in a million.
BAND_VALUES = 3
BANDS = 24
#: Leaders that a bucket's members are compared with at first.
FIRST_LEADERS = 2
#: The most frequent shingles that the order of shingles tells apart; the order never changes the result.
ORDERED_SHINGLES = 1 << 16
#: Of a set's map of shingles, words of 64 bits. A bit that only one of two sets has stands for a shingle that only it has.
MAP_WORDS = 16
BITS = [f"bits_{i}" for i in range(MAP_WORDS)]


def shingle_sets(w: T.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row by row in rising order, and the bounds of the rows."""
    n, rows = np.diff(w.firsts), len(w.firsts) - 1
    whole = np.flatnonzero(w.within(size))
    hasher = T.Hasher(w.hashes)
    of, values = w.rows[whole], hasher.runs(size)[whole]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        of = np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        of, values = of[order], np.concatenate([values, hasher(w.firsts[few], w.firsts[few + 1])])[order]
    bounds = np.searchsorted(of, np.arange(rows + 1))
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signatures(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """Rows x count values: under each of count/2 permutations the smallest and the largest hash."""
    rng = np.random.default_rng(20240501)
    factors = rng.integers(1 << 62, size=count // 2, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    shifts = rng.integers(1 << 63, size=count // 2, dtype=np.uint64)
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i, (x, y) in enumerate(zip(factors, shifts, strict=True)):
            moved = (values ^ y) * x
            out[full, 2 * i] = np.minimum.reduceat(moved, bounds[full])
            out[full, 2 * i + 1] = np.maximum.reduceat(moved, bounds[full])
    return out


def _sketched(size: int, bands: int, values: int):
    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(1))
            for a, b in T.chunks(bounds):
                sets, at = shingle_sets(T.words(data, bounds[a : b + 1]), size)
                n = np.diff(at)
                keys = signatures(sets, at, bands * values)
                # neighbouring values of a band come from different permutations
                order = np.arange(bands * values).reshape(values, bands)
                band = np.full((b - a, bands), 0x5851F42D4C957F2D, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for part in order:
                    band = T.mix(band ^ keys[:, part])
                nested = pa.ListArray.from_arrays(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32), pa.array(band.reshape(-1).view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), n, T.Hasher(sets)(at[:-1], at[1:]).view(np.int64), nested], names=["doc_id", "n", "set_key", "bands"])

    return T.giving_back(run)


def _confirmed(size: int, percent: int):
    """Of (a, b, text_a, text_b), the a and b whose shingle sets are alike enough."""

    def run(batches):
        for batch in batches:
            sides = []
            for column in (2, 3):
                data, bounds = T.flat(batch.column(column))
                own = []
                for a, b in T.chunks(bounds):
                    values, at = shingle_sets(T.words(data, bounds[a : b + 1]), size)
                    own += np.split(values, at[1:-1])
                sides.append(own)
            keep = np.zeros(batch.num_rows, bool)
            for row, (x, y) in enumerate(zip(*sides, strict=True)):
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                    both = np.sort(np.concatenate([x, y]))
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[row] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return T.giving_back(run)


def _rarest_first(size: int, percent: int, common: dict[int, int]):
    """(key, row, id, size, pos) of the shingles by which sets that are alike enough must meet, common ones last.

    Sets with `percent` of their union in common share one of each one's first n - ceil(percent * n / 100) + 1
    shingles in any order that holds for all sets; the order decides only how many others meet there.
    """
    keys = np.array(sorted(common), np.int64)
    ranks = np.array([common[k] for k in keys.tolist()], np.int64)

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(2))
            row, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b in T.chunks(bounds):
                values, at = shingle_sets(T.words(data, bounds[a : b + 1]), size)
                values = values.view(np.int64)
                n = np.diff(at)
                of = np.repeat(np.arange(b - a), n)
                found = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
                rank = np.where(keys[found] == values, ranks[found], 0) if len(keys) else np.zeros(len(values), np.int64)
                order = np.lexsort((values, rank, of))
                nth = np.arange(len(values)) - at[of]
                keep = nth < (n - (percent * n + 99) // 100 + 1)[of]
                yield pa.record_batch([values[order][keep], row[a + of[keep]], ids[a + of[keep]], n[of[keep]], nth[keep]], names=["key", "row", "id", "size", "pos"])

    return T.giving_back(run)


def _all_shingles(size: int):
    """(key, row) of every shingle of each set."""

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(2))
            row = np.asarray(batch.column(0))
            for a, b in T.chunks(bounds):
                values, at = shingle_sets(T.words(data, bounds[a : b + 1]), size)
                yield pa.record_batch([values.view(np.int64), np.repeat(row[a:b], np.diff(at))], names=["key", "row"])

    return T.giving_back(run)


def _maps(size: int):
    """(row, bits...) of each set: the bits that its shingles hash to."""

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(2))
            for a, b in T.chunks(bounds):
                values, at = shingle_sets(T.words(data, bounds[a : b + 1]), size)
                flags = np.zeros((b - a, 64 * MAP_WORDS), bool)
                flags[np.repeat(np.arange(b - a), np.diff(at)), values % np.uint64(64 * MAP_WORDS)] = True
                words = np.packbits(flags, axis=1).view(np.int64)
                yield pa.record_batch([batch.column(0).slice(a, b - a), *(np.ascontiguousarray(w) for w in words.T)], names=["row", *BITS])

    return T.giving_back(run)


def _by_rare_shingles(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, id, size, most, pos, bits...) of the sets in texts: rarest shingles, how many shingles another one has too, and maps."""
    texts = materialize(texts.select(F.xxhash64("id", "text").alias("row"), "id", "text").dropDuplicates(["row"]))
    times = materialize(texts.mapInArrow(_all_shingles(size), "key bigint, row bigint").groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("row")))
    often = times.where("n >= 8").select("key", "n").orderBy(F.desc("n"), "key").limit(ORDERED_SHINGLES)
    common = {key: n for key, n in often.collect()}  # only an order
    alone = times.where("n = 1").groupBy("row").agg(F.count("*").alias("alone"))
    maps = texts.mapInArrow(_maps(size), ", ".join(["row bigint", *(f"{b} bigint" for b in BITS)])).join(alone, "row", "left")
    rows = texts.mapInArrow(_rarest_first(size, percent, common), "key bigint, row bigint, id bigint, size bigint, pos bigint")
    return rows.join(maps, "row").select("key", "id", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"), "pos", *BITS)


def _shared(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Stored rows (key, id, size, most, comp, members) of the keys that more than one component has."""
    comp = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component") if labels else rows.withColumn("comp", F.col("id"))
    keys = comp.groupBy("key").agg(F.count("*").alias("members"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return materialize(comp.join(keys.select("key", "members"), "key"))


def _led(members: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each key's members with its leaders number first+1 to last, unless of one component already."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    leaders = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= last).where(F.col("rank") > first)
    bits = [b for b in ("pos", *BITS) if b in members.columns]
    leaders = leaders.select("key", *(F.col(c).alias(f"to_{c}") for c in ("id", "size", "most", "comp", *bits)))
    # no more can be shared than either has in common with any other set, nor what its map has and the other's lacks
    enough = "100 * {0} >= " + str(percent) + " * (size + to_size - {0})"
    near = "comp <> to_comp and " + enough.format("least(most, to_most)")
    if bits:
        # the first shingle that two sets share has all others behind it
        near += " and " + enough.format("least(size - pos, to_size - to_pos)")
        lacks = lambda x, y: " - ".join(f"bit_count({x}{b} & ~{y}{b})" for b in BITS)
        near += " and " + enough.format(f"least(size - {lacks('', 'to_')}, to_size - {lacks('to_', '')})")
    pairs = members.join(leaders, "key").where(near)
    return pairs.select(F.least("id", "to_id").alias("a"), F.greatest("id", "to_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, values: int = BAND_VALUES) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs`: the smallest doc_id that links lead to.

    docs: doc_id, text; other columns are not looked at. Two documents are linked if their sets of shingles have
    `percent` of their union in common. A text of fewer words than a shingle is one shingle; null, empty and blank
    texts have an empty set and stay alone, as do rows with a null doc_id (component null). Repeated rows each give
    a row; rows that share a doc_id are one node. An empty table gives no rows.

    Equal sets are linked to their smallest doc_id at once, and one of each goes on. In each bucket of a band, the
    members are compared with the bucket's first leaders, in one fixed order of all documents, so large groups of
    copies collapse without listing their pairs. Members of buckets that still hold several components mostly
    share a passage and little else. They are dealt anew by their rarest shingles: sets that are alike enough must
    share one of these, so nothing is lost, and passages that many share no longer bring texts together. There
    leaders follow in growing numbers until each key has one component or all its members have led; pairs that
    have too many shingles of their own to be alike are not listed.

    Ids that are no whole numbers go through a 64-bit hash; the smallest of a group is then by their own order.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        return _by_hashed_id(docs, size, percent, bands, values)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sketch = materialize(docs.mapInArrow(_sketched(size, bands, values), "doc_id bigint, n bigint, set_key bigint, bands array<bigint>"))
    known = sketch.where("n > 0 and doc_id is not null")
    sets = materialize(known.groupBy("set_key", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    members = _shared(sets.select(F.explode("bands").alias("key"), "id", F.col("n").alias("size"), F.col("n").alias("most")), None)
    named = materialize(members.select("id").distinct())
    # rows that share a doc_id but not a text: each text is a set of its own under that id
    texts = materialize(docs.join(small_list(named), docs.doc_id == named.id, "left_semi").withColumnRenamed("doc_id", "id"))
    own, other = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        met = pairs.join(own, "a").join(other, "b").select("a", "b", "text_a", "text_b")
        return materialize(met.mapInArrow(_confirmed(size, percent), "a bigint, b bigint"))

    links = [confirmed(_led(members, 0, FIRST_LEADERS, percent))]
    labels = components(links[0])
    members = _shared(members.drop("comp", "members"), labels).where(F.col("members") > FIRST_LEADERS)
    if not members.isEmpty():
        left = texts.join(small_list(materialize(members.select("id").distinct())), "id", "left_semi")
        members = _shared(_by_rare_shingles(left, size, percent), labels)
        first, last = 0, FIRST_LEADERS
        while not members.isEmpty():
            links.append(confirmed(_led(members, first, last, percent)))
            labels = components(_all(links))
            members = _shared(members.where(F.col("members") > last).drop("comp", "members"), labels)
            first, last = last, 16 * last
    equal = known.join(sets.select("set_key", "n", "id"), ["set_key", "n"]).select("doc_id", "id")
    labels = labels.withColumnRenamed("node", "id")
    found = equal.join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component")).where("doc_id <> component")
    several = materialize(found.distinct())
    # a doc_id with several texts may be in several groups, which it then links
    if known.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").isEmpty():
        final = several.withColumnRenamed("doc_id", "node")
    else:
        final = components(several.toDF("a", "b"))
    return sketch.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def _by_hashed_id(docs: DataFrame, size: int, percent: int, bands: int, values: int) -> DataFrame:
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    names = materialize(docs.where("doc_id is not null").select(key.alias("key"), F.col("doc_id").alias("name")).distinct())
    found = materialize(near_duplicates(docs.select(key.alias("doc_id"), "text"), size, percent, bands, values))
    groups = found.where("doc_id is not null").select(F.col("doc_id").alias("key"), "component_id").distinct().join(names, "key")
    least = groups.groupBy("component_id").agg(F.min("name").alias("least"))
    of = groups.join(least, "component_id").select("key", "name", "least")
    return found.join(of, found.doc_id == of.key, "left").select(F.col("name").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs`, all columns: of each group of near copies the one with the smallest doc_id.

    Rows with a null doc_id and those without words stay. Rows are told apart by doc_id and text: unlike texts of one
    doc_id all stay, near copies among them count like those of other ids, and of rows with both the same one stays.
    """
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        found = near_duplicates(docs, size, percent)
        gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
        return docs.join(small_list(gone), "doc_id", "left_anti").select(*docs.columns)
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keyed = docs.withColumn("__key", key)
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), size, percent).where("doc_id is not null")
    groups = materialize(found.select(F.col("doc_id").alias("__key"), "component_id").distinct())
    ids = keyed.where("__key is not null").select("__key", "doc_id").distinct()
    first = groups.join(ids, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("first"))
    gone = materialize(groups.join(first, "component_id").where("__key <> first.__key").select("__key"))
    left = keyed.join(small_list(gone), "__key", "left_anti")
    order = Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))
    copies = materialize(left.where("__key is not null").groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"))
    one = left.join(small_list(copies), "__key", "left_semi").withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return left.join(small_list(copies), "__key", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
