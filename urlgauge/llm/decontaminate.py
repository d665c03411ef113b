"""Benchmark decontamination by winnowed fingerprints.

Of every window of a benchmark item and of every window of a document, the smallest hash of k consecutive words
is kept (winnowing). A shared window always shares its smallest hash, so joining the two fingerprint sets finds
every shared span of a window or more; each hit is then extended and compared word by word. Items shorter than
a window are one window each and are looked for by their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T

WINDOW = 10
GRAM = 5
#: Benchmarks up to this many bytes of text are sent whole to every task; larger ones are met by a shuffled join.
BROADCAST_BYTES = 16 << 20
SPANS = "array<struct<first:int,last:int>>"


class Windows:
    """Windows of some items, by their hash: normalised text and the ids of the items that have it."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        self.window, self.by_length = window, {}
        data, bounds = T.flat(texts)
        w = T.words(data, bounds, T.NON_WORD)
        for row, item in enumerate(ids):
            first, last = int(w.firsts[row]), int(w.firsts[row + 1])
            n = min(window, last - first)
            if n:
                known = self.by_length.setdefault(n, {})
                for at, key in zip(range(first, last - n + 1), T.Hasher(w.hashes[first:last]).runs(n).tolist(), strict=True):
                    known.setdefault(key, {}).setdefault(w.text(at, at + n), set()).add(item)
        self.keys = {n: np.sort(np.fromiter(known, np.uint64, len(known))) for n, known in self.by_length.items()}
        gram = min(GRAM, window)
        marks = [T.Hasher(w.hashes[f:l]).runs(gram) for f, l in zip(w.firsts[:-1], w.firsts[1:], strict=True) if l - f >= window]
        self.marks = np.unique(np.concatenate([fingerprints(m, window - gram + 1) for m in marks])) if marks else np.zeros(0, np.uint64)

    def hits(self, w: T.Words) -> list[tuple[int, int, set]]:
        """(first word, last word, item ids) of each window of the words that an item has."""
        places = []
        gram = min(GRAM, self.window)
        if len(self.marks) and len(w.hashes) >= self.window:
            grams = T.Hasher(w.hashes).runs(gram)
            place, first, last = T.minimisers(grams, self.window - gram + 1, w.within(self.window))
            shared = isin(grams[place], self.marks)
            # extend: every window that chose the shared fingerprint
            places.append((self.window, expand(first[shared], last[shared])))
        for n in self.by_length:
            if n < self.window and len(w.hashes) >= n:
                places.append((n, np.flatnonzero(w.within(n) & isin(T.Hasher(w.hashes).runs(n), self.keys[n]))))
        found = []
        for n, at in places:
            if len(at):
                keys = T.Hasher(w.hashes)(at, at + n)
                keep = isin(keys, self.keys[n])
                for place, key in zip(at[keep].tolist(), keys[keep].tolist(), strict=True):
                    if ids := self.by_length[n][key].get(w.text(place, place + n)):
                        found.append((place, place + n, ids))
        return found


def isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first..last."""
    size = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def fingerprints(grams: np.ndarray, window: int) -> np.ndarray:
    """The smallest hashes of each window of grams."""
    place, _, _ = T.minimisers(grams, window, np.ones(max(len(grams) - window + 1, 0), bool))
    return grams[place]


def _matched(batches, windows):
    """Rows of (key columns..., n_words, item_ids, spans), for batches whose last column is the text."""
    for batch in batches:
        data, bounds = T.flat(batch.column(batch.num_columns - 1))
        counts, items, spans = [], [], []
        for a, b in T.chunks(bounds):
            w = T.words(data, bounds[a : b + 1], T.NON_WORD)
            own: dict[int, list] = {}
            for hit in windows().hits(w):
                own.setdefault(int(w.rows[hit[0]]), []).append(hit)
            for row in range(b - a):
                base, n, hits = int(w.firsts[row]), int(w.firsts[row + 1] - w.firsts[row]), own.get(row, ())
                counts.append(n)
                items.append(sorted({str(i) for *_, ids in hits for i in ids if i is not None}))
                if hits:
                    at = np.array([h[:2] for h in hits]) - base
                    s, e = T.run_bounds(T.covered(at[:, 0], at[:, 1], n))
                    spans.append([{"first": x, "last": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                else:
                    spans.append([])
        yield pa.record_batch(
            [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
            names=[*batch.schema.names[:-1], "n_words", "item_ids", "spans"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, item_ids (as sorted strings) and spans (word ranges hit) of each row of `docs`.

    docs: doc_id, text; benchmark: item_id, text; other columns are not looked at. A null text has no words. An
    item without words matches nothing; an item with a null id marks words but is not listed. Repeated rows each
    give a row. An empty benchmark gives rows without hits, an empty `docs` no rows.

    The benchmark is sent to the tasks if its text has at most `broadcast_bytes` bytes: one pass without any
    shuffle of documents. Beyond that, fingerprints of both sides are joined by shuffle, and only documents and
    items that share one meet again.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    if _text_bytes(items) <= broadcast_bytes:
        return _by_broadcast(docs, items, window)
    return _by_join(docs, items, window)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")


def _text_bytes(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]


def _schema(docs: DataFrame, *names: str) -> str:
    kinds = dict(docs.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def _sent(items: DataFrame, window: int):
    """A function that gives a task the `Windows` of all items, made once for each worker call."""
    rows = items.collect()
    known = items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
    made: list[Windows] = []

    def windows() -> Windows:
        if not made:
            ids, texts = known.value
            made.append(Windows(ids, pa.array(texts, pa.string()), window))
        return made[0]

    return windows


def _by_broadcast(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    windows = _sent(items, window)
    return docs.mapInArrow(lambda batches: _matched(batches, windows), f"{_schema(docs, 'doc_id')}, n_words long, item_ids array<string>, spans {SPANS}")


def _by_join(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Fingerprints meet by shuffle; then each document meets each item that it shares one with."""
    items = items.withColumn("_item", F.xxhash64("item_id", "text")).dropDuplicates(["_item"])
    docs = docs.withColumn("_doc", F.xxhash64("doc_id", "text"))
    schema = "key long, n int, h long"
    brief = items.select("_item", "text").mapInArrow(_short_marks(window), schema)
    short = sorted(r[0] for r in brief.select("n").distinct().collect())  # at most `window` numbers
    own = docs.select("_doc", "text").mapInArrow(_marks(window, short), schema)
    long_items = items.select("_item", "text").mapInArrow(_marks(window, []), schema)
    pairs = own.withColumnRenamed("key", "_doc").join(long_items.union(brief).withColumnRenamed("key", "_item"), ["n", "h"]).select("_doc", "_item").distinct()
    parts = pairs.join(items, "_item").select("_doc", "item_id", F.col("text").alias("_item_text"))
    both = parts.join(docs.dropDuplicates(["_doc"]).select("_doc", "text"), "_doc").select("_doc", "item_id", "_item_text", "text")

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                w = Windows(one.column(1).to_pylist(), one.column(2), window)
                yield from _matched([one.select([0, 3])], lambda w=w: w)

    found = both.mapInArrow(compare, f"_doc long, n_words long, item_ids array<string>, spans {SPANS}").where("size(spans) > 0")
    # each document's spans and items, put together
    ids = found.select("_doc", F.explode_outer("item_ids").alias("i")).groupBy("_doc").agg(F.array_sort(F.collect_set("i")).alias("item_ids"))
    spans = found.groupBy("_doc").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
    merge = F.expr(
        "aggregate(spans, cast(array() as array<struct<first:int,last:int>>), (a, x) -> case when size(a) > 0 and element_at(a, -1).last >= x.first"
        " then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last))))"
        " else concat(a, array(x)) end)"
    )
    hit = ids.join(spans, "_doc").select("_doc", "item_ids", merge.alias("spans"))

    def count(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(2))
            n = [np.diff(T.words(data, bounds[a : b + 1], T.NON_WORD).firsts) for a, b in T.chunks(bounds)]
            yield pa.record_batch([batch.column(0), batch.column(1), np.concatenate(n) if n else np.zeros(0, np.int64)], names=["doc_id", "_doc", "n_words"])

    counted = docs.select("doc_id", "_doc", "text").mapInArrow(count, f"{_schema(docs, 'doc_id', '_doc')}, n_words long")
    none = F.expr(f"cast(array() as {SPANS})")
    return counted.join(hit, "_doc", "left").select("doc_id", "n_words", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"), F.coalesce("spans", none).alias("spans"))


def _marks(window: int, short: list[int]):
    """(key, length, hash): minimisers of whole windows, and every run of the lengths `short`."""
    gram = min(GRAM, window)

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(1))
            keys = np.asarray(batch.column(0))
            for a, b in T.chunks(bounds):
                w = T.words(data, bounds[a : b + 1], T.NON_WORD)
                grams = T.Hasher(w.hashes).runs(gram)
                place, _, _ = T.minimisers(grams, window - gram + 1, w.within(window))
                parts = [(window, w.rows[place], grams[place])]
                for n in short:
                    ok = np.flatnonzero(w.within(n))
                    parts.append((n, w.rows[ok], T.Hasher(w.hashes).runs(n)[ok]))
                for n, rows, h in parts:
                    row, h = np.unique(np.stack([rows.astype(np.uint64), h]), axis=1)
                    yield pa.record_batch([keys[a + row.astype(np.int64)], np.full(len(row), n, np.int32), h.view(np.int64)], names=["key", "n", "h"])

    return run


def _short_marks(window: int):
    """(key, length, hash) of each whole text of fewer words than a window."""

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(1))
            w = T.words(data, bounds, T.NON_WORD)
            n = np.diff(w.firsts)
            ok = np.flatnonzero((n > 0) & (n < window))
            yield pa.record_batch([np.asarray(batch.column(0))[ok], n[ok].astype(np.int32), T.Hasher(w.hashes)(w.firsts[ok], w.firsts[ok + 1]).view(np.int64)], names=["key", "n", "h"])

    return run


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of a `contamination` result."""
    hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.last - x.first)")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `docs` without any benchmark window, with all their columns; without a shuffle for a small benchmark."""
    items = _items(benchmark)
    if _text_bytes(items) <= broadcast_bytes:
        windows = _sent(items, window)

        def run(batches):
            for batch in batches:
                data, bounds = T.flat(batch.column("text"))
                keep = np.ones(batch.num_rows, bool)
                for a, b in T.chunks(bounds):
                    w = T.words(data, bounds[a : b + 1], T.NON_WORD)
                    keep[[a + int(w.rows[hit[0]]) for hit in windows().hits(w)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    bad = contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark, window, broadcast_bytes).where("size(spans) > 0").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").drop("_key")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
