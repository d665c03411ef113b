"""Exact top-k search by inner product with a pivot-distance index.

A vector x gets one more component, sqrt(M^2 - |x|^2), so that the largest inner products are the nearest
vectors. Each is keyed by its nearest pivot and the distance to it; rows sorted by that key are cut into annuli.
By the triangle inequality |d(q, p) - d(x, p)| bounds the distance of a query from everything in an annulus, so
an annulus is looked at only by queries whose k-th best score so far it could still reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlgauge.session import materialize

PIVOTS = 32
#: Rows that the pivots are fitted on at most, chosen by a hash of the id. The index holds every row.
FIT_ROWS = 4_096
ANNULUS_ROWS = 512
#: Queries are sent to the tasks in blocks of at most this many bytes; each block is one pass over the index.
QUERY_BYTES = 32 << 20
SCALE = 1024


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q (floor(1024 * x) of each component) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


@dataclass
class Pivots:
    """Pivots of each vector length, in the augmented space; `top` is the largest squared norm."""

    top: float
    by_length: dict[int, np.ndarray]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))])

    def of(self, length: int) -> np.ndarray:
        return self.by_length.get(length, np.zeros((1, length + 1)))

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Rows x pivots, of augmented rows."""
        p = self.of(y.shape[1] - 1)
        return np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * y @ p.T, 0))


def _fit(sample: list[np.ndarray], top: float, pivots: int) -> Pivots:
    """A few rounds of k-means from a spread start, for each length of vectors."""
    out = Pivots(top, {})
    lengths: dict[int, list[np.ndarray]] = {}
    for x in sample:
        lengths.setdefault(len(x), []).append(x)
    for length, rows in lengths.items():
        y = out.augmented(np.array(rows, np.float64).reshape(len(rows), length))
        centres = y[:: max(len(y) // pivots, 1)][:pivots].copy()
        for _ in range(8):
            out.by_length[length] = centres
            near = out.distances(y).argmin(axis=1)
            for i in np.unique(near):
                centres[i] = y[near == i].mean(axis=0)
    return out


def _matrices(batch_ids, column):
    """(rows, matrix) of each vector length in a list column."""
    at = np.asarray(column.offsets)
    sizes, values = np.diff(at), np.asarray(column.flatten()).astype(np.float64)
    base = at - at[0]
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, values[(base[rows][:, None] + np.arange(length)).ravel()].reshape(len(rows), length)


def _keyed(pivots):
    def run(batches):
        for batch in batches:
            near, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            size = np.zeros(batch.num_rows, np.int32)
            for length, rows, x in _matrices(batch.column(0), batch.column(1)):
                d = pivots.value.distances(pivots.value.augmented(x))
                near[rows] = d.argmin(axis=1)
                dist[rows], size[rows] = d.min(axis=1), length
            yield pa.record_batch([size, near, dist, batch.column(0), batch.column(1)], names=["length", "pivot", "dist", "vec_id", "q"])

    return run


def _annuli(rows_each: int):
    """Consecutive rows of one pivot, without rows that repeat id and vector."""

    def run(batches):
        held, seen = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == seen:
                    continue
                seen = row
                if held and (len(held) >= rows_each or held[-1][:2] != row[:2]):
                    yield _block(held)
                    held = []
                held.append(row)
        if held:
            yield _block(held)

    return run


def _block(rows: list[tuple]) -> pa.RecordBatch:
    length, pivot, _, _, _ = rows[0]
    data = np.array([r[4] for r in rows], np.int64).tobytes()
    columns = [[length], [pivot], [rows[0][2]], [rows[-1][2]], [[r[3] for r in rows]], [data]]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["length", "pivot", "low", "high", "ids", "data"])


def _firsts(query: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first row of each pair, among rows sorted by query and id."""
    order = np.lexsort((ids, query))
    q, i = query[order], ids[order]
    return np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])[: len(q)])


class _Best:
    """The best k of each query that a task has seen."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.parts, self.size = k, least.copy(), [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        self.parts.append((query, ids, scores))
        self.size += len(query)
        if self.size > 400_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        # an id with several vectors counts once, by its best score: its first row in this order
        once = np.sort(np.lexsort((np.arange(len(query)), ids, query))[_firsts(query, ids)])
        query, ids, scores = query[once], ids[once], scores[once]
        heads = np.flatnonzero(np.diff(query, prepend=-1))
        nth = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
        full = nth == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], scores[full])
        keep = nth < self.k
        self.parts, self.size = [(query[keep], ids[keep], scores[keep])], int(keep.sum())
        return self.parts[0]


def _searched(pivots, sent, k: int):
    def run(batches):
        queries = {length: _Queries(pivots.value, *q) for length, q in sent.value.items()}
        best = {length: _Best(k, q.least) for length, q in queries.items()}
        for batch in batches:
            for length, pivot, low, high, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length not in queries:
                    continue
                q, found = queries[length], best[length]
                gap = np.maximum(np.maximum(q.dist[:, pivot] - high, low - q.dist[:, pivot]), 0)
                reach = (q.norm + pivots.value.top - gap * gap) / 2
                live = np.flatnonzero(reach * (1 + 1e-9) + 1e-6 * (1 + pivots.value.top) >= found.least)
                if not len(live):
                    continue
                x = np.frombuffer(data, np.int64).reshape(len(ids), length)
                scores = q.scores(live, x)
                own = np.array(ids)
                hit, at = np.nonzero((scores >= found.least[live][:, None]) & (q.ids[live][:, None] != own))
                found.add(live[hit], own[at], scores[hit, at])
        for length, found in best.items():
            query, ids, scores = found.settle()
            yield pa.record_batch([queries[length].ids[query], ids.astype(np.int64), scores.astype(np.int64)], names=["query_id", "vec_id", "score"])

    return run


class _Queries:
    def __init__(self, pivots: Pivots, ids: np.ndarray, x: np.ndarray, least: np.ndarray):
        self.ids, self.x, self.least = ids, x, least
        y = x.astype(np.float64)
        self.norm = (y * y).sum(axis=1)
        self.dist = pivots.distances(np.column_stack([y, np.zeros(len(y))]))
        # products of doubles are exact while every sum stays below 2**53
        self.exact = (np.sqrt(self.norm.max(initial=0)) * np.sqrt(pivots.top)) < 2**52
        self.double = y

    def scores(self, live: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.double[live] @ x.T.astype(np.float64)).astype(np.int64)
        return self.x[live] @ x.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each row of `queries` with `vectors`.

    Both: vec_id, q (whole numbers), as `quantised` gives them. A query's own id is no candidate; ties go to the
    smaller vec_id; vectors meet only vectors of their length. Rows that repeat id and vector count once; where
    an id has several vectors, its best score counts. An empty table gives no rows. Exact: the pivots are fitted
    on a sample, but every row is indexed and bounds only skip what cannot be among the best.
    """
    spark = vectors.sparkSession
    squared = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, top = vectors.agg(F.count("*"), F.max(squared)).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not total:
        return spark.createDataFrame([], schema)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(FIT_ROWS).toArrow()
    sample_ids, sample = np.asarray(rows.column(0)), [np.asarray(x.values) for x in rows.column(1)]
    fitted = spark.sparkContext.broadcast(_fit(sample, float(top), pivots))
    keyed = vectors.mapInArrow(_keyed(fitted), "length int, pivot int, dist double, vec_id bigint, q array<bigint>")
    order = ["length", "pivot", "dist", "vec_id", "q"]
    index = keyed.repartitionByRange("length", "pivot", "dist", "vec_id").sortWithinPartitions(*order)
    index = materialize(index.mapInArrow(_annuli(ANNULUS_ROWS), "length int, pivot int, low double, high double, ids array<bigint>, data binary"))
    asked = materialize(queries.select(F.col("vec_id").alias("query_id"), "q").distinct())
    size = asked.agg(F.coalesce(F.sum(F.size("q") * 8 + 64), F.lit(0))).first()[0]
    blocks = -(-size // query_bytes)
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        sent = spark.sparkContext.broadcast(_starts(np.asarray(part.column(0)), [np.asarray(x.values) for x in part.column(1)], sample_ids, sample, k))
        own = index.mapInArrow(_searched(fitted, sent, k), "query_id bigint, vec_id bigint, score bigint")
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _starts(ids: np.ndarray, rows: list[np.ndarray], sample_ids: np.ndarray, sample: list[np.ndarray], k: int) -> dict:
    """Queries by length, each with the k-th best score among the sample: a first bound that rows of the table give."""
    out = {}
    for length in {len(r) for r in rows}:
        own = [i for i, r in enumerate(rows) if len(r) == length]
        x = np.array([rows[i] for i in own], np.int64).reshape(len(own), length)
        _, once = np.unique(sample_ids, return_index=True)
        near = [i for i in once.tolist() if len(sample[i]) == length]
        least = np.full(len(own), np.iinfo(np.int64).min + 1)
        if len(near) > k:
            y = np.array([sample[i] for i in near], np.float64).reshape(len(near), length)
            for at in range(0, len(own), 1024):
                part = slice(at, at + 1024)
                scores = x[part].astype(np.float64) @ y.T
                scores[ids[own][part][:, None] == sample_ids[near]] = -np.inf
                kth = np.partition(scores, -k, axis=1)[:, -k]
                least[part] = np.floor(kth - np.abs(kth) * 1e-9 - 1)
        out[length] = (ids[own], x, least)
    return out


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
