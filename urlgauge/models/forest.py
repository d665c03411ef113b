"""Random forests without a limit on depth, grown in two phases.

While a node holds many rows, it is split on histograms: each task adds up its rows per node, column and bin, Spark sums
these and picks the best cuts, all trees a level at a time. A node that has become small is dealt, with its rows, to a
task that finishes its subtree on the values themselves, however deep. A row's copies in a tree's sample follow a hash of
its content, so a lost task draws the same ones again.
"""

from __future__ import annotations

import base64
import json
import math
import pickle
import zlib
from collections import defaultdict
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlgauge.models.trees import Tree, _matrix, _Shared, _uniform, counted_rows, edges_of, summarise
from urlgauge.operators.split import exact_sample
from urlgauge.session import materialize

#: Labelled rows a forest is fitted on at most: an exact sample by a hash of the row. Its trees grow with its rows.
FIT_ROWS = 500_000
#: Different rows of a node that one task finishes.
NODE_ROWS = 20_000
#: Bins of a column while nodes are large.
BINS = 64


@dataclass(frozen=True)
class ForestRules:
    """columns: how many each split looks at (0: the square root of all); depth: 0 for no limit."""

    trees: int = 200
    columns: int = 0
    depth: int = 0
    bootstrap: bool = True
    node_rows: int = NODE_ROWS
    rows: int = FIT_ROWS
    seed: int = 42


def copies(keys: np.ndarray, counts: np.ndarray, tree: int, rules: ForestRules) -> np.ndarray:
    """How often a tree's sample holds each row: Poisson numbers around its count, by a hash of row and tree."""
    if not rules.bootstrap:
        return counts
    u, mean = _uniform(keys, rules.seed, tree), counts.astype(float)
    out = np.zeros(len(counts), np.int64)
    part = np.exp(-mean)
    upto, nth = part.copy(), 0
    active = np.flatnonzero((u >= upto) & (mean <= 64))
    while len(active):
        nth += 1
        part[active] *= mean[active] / nth
        upto[active] += part[active]
        out[active] = nth
        active = active[(u[active] >= upto[active]) & (nth < 400)]
    many = np.flatnonzero(mean > 64)  # near enough to normal
    if len(many):
        spread = np.sqrt(-2 * np.log(np.maximum(u[many], 1e-300))) * np.cos(2 * np.pi * _uniform(keys[many], rules.seed, tree, 1))
        out[many] = np.maximum(np.rint(mean[many] + np.sqrt(mean[many]) * spread), 0)
    return out


def _order(count: int, *salts: int) -> np.ndarray:
    return np.argsort(_uniform(np.arange(count), *salts), kind="stable")


def _purity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a + b * b) / np.maximum(a + b, 1e-12)


def finish(x: np.ndarray, y: np.ndarray, weight: np.ndarray, salts: tuple[int, ...], look: int, room: int = 0) -> Tree:
    """A whole subtree on the values: every leaf is pure, or its rows are equal in all columns (or `room` levels deep).

    A split looks at `look` columns drawn for the node, and at further ones only while none of them can split it.
    """
    tree = Tree.stump()
    work = [(0, np.arange(len(y)), 0)]
    while work:
        node, rows, level = work.pop()
        ones, all_ = float((weight[rows] * y[rows]).sum()), float(weight[rows].sum())
        tree.value[node] = ones / all_ if all_ else 0.0
        if ones in (0.0, all_) or (room and level >= room):
            continue
        best = (-1.0, -1, 0.0)
        for nth, column in enumerate(_order(x.shape[1], *salts, node).tolist()):
            if nth >= look and best[1] >= 0:
                break
            order = rows[np.argsort(x[rows, column], kind="stable")]
            values = x[order, column]
            at = np.flatnonzero(values[1:] > values[:-1])
            if not len(at):
                continue
            left = np.cumsum(weight[order] * y[order])[at], np.cumsum(weight[order])[at]
            gain = _purity(left[0], left[1] - left[0]) + _purity(ones - left[0], all_ - left[1] - (ones - left[0]))
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), column, (values[at[k]] + values[at[k] + 1]) / 2)
        if best[1] < 0:
            continue
        goes_left = x[rows, best[1]] <= best[2]
        if goes_left.all():  # the middle of two neighbours that rounding has made the upper one
            best = (best[0], best[1], float(x[rows, best[1]][x[rows, best[1]] < best[2]].max()))
            goes_left = x[rows, best[1]] <= best[2]
        left, right = tree.split(node, best[1], best[2], best[0], (0.0, 0.0))
        work += [(right, rows[~goes_left], level + 1), (left, rows[goes_left], level + 1)]
    return tree


def _nodes(tree: Tree, x: np.ndarray) -> np.ndarray:
    numbers = Tree(tree.column, tree.cut, tree.left, tree.right, list(range(len(tree.column))), tree.gain)
    return numbers.scores(x).astype(np.int64)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    return _matrix(pa.chunked_array([batch.column(0)]), n), *(np.asarray(batch.column(i)) for i in (1, 2, 3))


def _edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Bin edges of all columns from merged summaries; a few thousand points of each reach the driver."""

    def run(batches):
        parts = [[] for _ in range(width)]
        for batch in batches:
            x, _, n, _ = _columns(batch)
            for own, column in zip(parts, x.T, strict=True):
                own.append(summarise(column, n.astype(float)))
                if len(own) > 8:
                    own[:] = [_merged(own)]
        for i, own in enumerate(parts):
            values, weights = _merged(own)
            yield pa.record_batch([pa.array([i]), pa.array([values.tolist()]), pa.array([weights.tolist()])], names=["column", "values", "weights"])

    def merge(key, table: pa.Table) -> pa.Table:
        own = [(np.array(v), np.array(w)) for v, w in zip(table.column("values").to_pylist(), table.column("weights").to_pylist(), strict=True)]
        values, weights = _merged(own)
        return pa.table({"column": [key[0].as_py()], "values": [values.tolist()], "weights": [weights.tolist()]})

    schema = "column long, values array<double>, weights array<double>"
    found = rows.mapInArrow(run, schema)
    # summaries of many tasks merge in two steps, so that no task sees all of them
    found = found.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("column", "some").applyInArrow(lambda k, t: merge(k, t), schema)
    found = found.groupBy("column").applyInArrow(lambda k, t: merge(k, t), schema)
    edges = [np.zeros(0)] * width
    for row in found.collect():
        edges[row["column"]] = edges_of(np.array(row["values"]), np.array(row["weights"]), BINS)
    return edges


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0), np.zeros(0)
    return summarise(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]))


def _histograms(trees: list[Tree], large: dict[int, dict[int, int]], edges: list[np.ndarray], rules: ForestRules, look: int):
    """Rows (tree, node, column, bin, zeros, ones, members) of a task's rows in large nodes."""

    def run(batches):
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            x, y, n, keys = _columns(batch)
            bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
            for t, own in large.items():
                weight = copies(keys, n, t, rules)
                at = _nodes(trees[t], x)
                for node, turn in own.items():
                    rows = np.flatnonzero((at == node) & (weight > 0))
                    if not len(rows):
                        continue
                    order = _order(x.shape[1], rules.seed, t, node)
                    for c in (order[:look] if turn == 0 else order).tolist():
                        size = len(edges[c]) + 1
                        part = sums.setdefault((t, node, c), np.zeros((3, size), np.int64))
                        w, b, one = weight[rows], bins[rows, c], y[rows] > 0
                        for k, s in enumerate((w * ~one, w * one, np.ones(len(rows)))):
                            part[k] += np.bincount(b, s, size).astype(np.int64)
        for (t, node, c), part in sums.items():
            b = np.flatnonzero(part[2])
            fill = lambda v: np.full(len(b), v, np.int64)  # noqa: B023, E731
            yield pa.record_batch([fill(t), fill(node), fill(c), b, *(p[b] for p in part)], names=["tree", "node", "column", "bin", "zeros", "ones", "members"])

    return run


def _best_cuts(found: DataFrame) -> DataFrame:
    """(tree, node, zeros, ones, members, best): the purest cut of each node, null if no column can split it."""
    keys = ["tree", "node", "column"]
    summed = found.groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "members")])
    line = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    upto = summed.select(
        *keys, "bin", *[F.sum(c).over(line).alias(f"left_{c}") for c in ("zeros", "ones", "members")], *[F.sum(c).over(whole).alias(c) for c in ("zeros", "ones", "members")]
    )
    pure = lambda a, b: (a * a + b * b) / (a + b)
    zeros, ones = F.col("left_zeros").cast("double"), F.col("left_ones").cast("double")
    gain = pure(zeros, ones) + pure(F.col("zeros") - zeros, F.col("ones") - ones)
    able = F.col("left_members") < F.col("members")
    cut = F.when(able, F.struct(gain.alias("gain"), (-F.col("column")).alias("column"), (-F.col("bin")).alias("bin"), "left_members"))
    return upto.groupBy("tree", "node").agg(F.max("zeros").alias("zeros"), F.max("ones").alias("ones"), F.max("members").alias("members"), F.max(cut).alias("best"))


def fit_forest(df: DataFrame, features: str, label: str, rules: ForestRules) -> list[Tree]:
    """The trees of a table with a vector column and a 0/1 label; null labels are left out."""
    rows = counted_rows(df, features, label)
    rows = materialize(rows)
    if rows.isEmpty():
        raise ValueError("no labelled rows")
    total = rows.count()
    width = len(rows.first()["x"])
    look = rules.columns or max(int(math.sqrt(width)), 1)
    trees = [Tree.stump() for _ in range(rules.trees)]
    levels = [{0: 0} for _ in trees]
    # nodes that are still large, with how often their columns were drawn in vain
    large = {t: {0: 0} for t in range(rules.trees)} if total > rules.node_rows else {}
    edges = _edges(rows, width) if large else []
    ended: set[tuple[int, int]] = set()
    while large:
        schema = "tree long, node long, column long, bin long, zeros long, ones long, members long"
        best = _best_cuts(rows.mapInArrow(_histograms(trees, large, edges, rules, look), schema)).collect()  # a row for each large node
        following: dict[int, dict[int, int]] = defaultdict(dict)
        for row in best:
            t, node, cut = row["tree"], row["node"], row["best"]
            tree, deep = trees[t], levels[t][node]
            tree.value[node] = row["ones"] / max(row["ones"] + row["zeros"], 1)
            if row["members"] <= rules.node_rows and node == 0:
                continue  # the sample of this tree is small already
            if not row["ones"] or not row["zeros"] or (rules.depth and deep >= rules.depth):
                ended.add((t, node))
            elif cut is None and large[t][node] == 0:
                following[t][node] = 1
            elif cut is not None:
                children = tree.split(node, -cut["column"], float(edges[-cut["column"]][-cut["bin"]]), cut["gain"], (0.0, 0.0))
                for child, members in zip(children, (cut["left_members"], row["members"] - cut["left_members"]), strict=True):
                    levels[t][child] = deep + 1
                    if members > rules.node_rows:
                        following[t][child] = 0
        large = dict(following)
    for (t, node), subtree in _subtrees(rows, trees, levels, ended, rules, look):
        _graft(trees[t], node, subtree)
    return trees


def _subtrees(rows: DataFrame, trees: list[Tree], levels: list[dict[int, int]], ended: set[tuple[int, int]], rules: ForestRules, look: int):
    """((tree, node), subtree) of every node that is not finished yet, each grown in a task with its rows."""

    def deal(batches):
        for batch in batches:
            x, y, n, keys = _columns(batch)
            for t, tree in enumerate(trees):
                weight, at = copies(keys, n, t, rules), _nodes(tree, x)
                for node in np.unique(at[weight > 0]).tolist():
                    if (t, node) in ended:
                        continue
                    own = np.flatnonzero((at == node) & (weight > 0))
                    pick = pa.array(own)
                    yield pa.record_batch([pa.array(np.full(len(own), t)), pa.array(np.full(len(own), node)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(weight[own]), batch.column(3).take(pick)], names=["tree", "node", "x", "y", "w", "key"])

    def grow(key, table: pa.Table) -> pa.Table:
        t, node = (k.as_py() for k in key)
        x = _matrix(table.column("x"), table.num_rows)
        y, w, h = (np.asarray(table.column(c)) for c in ("y", "w", "key"))
        order = np.lexsort((*x.T, y, h))  # the same for any order of arrival
        room = max(rules.depth - levels[t][node], 0) if rules.depth else 0
        if rules.depth and not room:
            room = -1
        tree = finish(x[order], y[order], w[order], (rules.seed, t, node), look, room) if room >= 0 else Tree.stump()
        return pa.table({"tree": [t], "node": [node], "grown": [_packed([tree])]})

    dealt = rows.mapInArrow(deal, "tree long, node long, x array<double>, y double, w long, key long")
    grown = dealt.groupBy("tree", "node").applyInArrow(lambda k, t: grow(k, t), "tree long, node long, grown binary")
    for row in grown.toLocalIterator():
        yield (row["tree"], row["node"]), _unpacked(bytes(row["grown"]))[0]


def _graft(tree: Tree, node: int, subtree: Tree) -> None:
    place = [node, *range(len(tree.column), len(tree.column) + len(subtree.column) - 1)]
    move = lambda child: place[child] if child >= 0 else -1
    moved = list(zip(subtree.column, subtree.cut, map(move, subtree.left), map(move, subtree.right), subtree.value, subtree.gain, strict=True))
    for own, first in zip((tree.column, tree.cut, tree.left, tree.right, tree.value, tree.gain), moved[0], strict=True):
        own[node] = first
    for values in moved[1:]:
        for own, value in zip((tree.column, tree.cut, tree.left, tree.right, tree.value, tree.gain), values, strict=True):
            own.append(value)


def _packed(trees: list[Tree]) -> bytes:
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64, np.float64)
    return zlib.compress(pickle.dumps([[np.array(v, k) for v, k in zip(vars(t).values(), kinds, strict=True)] for t in trees]))


def _unpacked(data: bytes) -> list[Tree]:
    return [Tree(*(a.tolist() for a in arrays)) for arrays in pickle.loads(zlib.decompress(data))]  # noqa: S301


class ForestModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction: the mean of the trees' leaf shares."""

    trees = Param(Params._dummy(), "trees", "packed trees", TypeConverters.toString)

    def __init__(self, trees: str = "", featuresCol: str = "features"):
        super().__init__()
        self._set(trees=trees, featuresCol=featuresCol)

    def all_trees(self) -> list[Tree]:
        return _unpacked(base64.b64decode(self.getOrDefault("trees")))

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.all_trees())  # bounded by the rows of the fit

        @F.pandas_udf("double")
        def share(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.stack(x.to_numpy())
            return pd.Series(sum((t.scores(rows) for t in sent.value), np.zeros(len(rows))) / len(sent.value))

        out = df.withColumn("_share", share(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        p = F.col("_share")
        return out.select(
            *df.columns,
            array_to_vector(F.array(1 - p, p)).alias("rawPrediction"),
            array_to_vector(F.array(1 - p, p)).alias("probability"),
            (p > 0.5).cast("double").alias("prediction"),
        )


class DeepForest(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """200 trees without a limit on depth, each split on the square root of the columns."""

    settings = Param(Params._dummy(), "settings", "rules as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", settings=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, settings=settings or json.dumps(asdict(ForestRules())))

    def rules(self) -> ForestRules:
        return ForestRules(**json.loads(self.getOrDefault("settings")))

    def _fit(self, df: DataFrame) -> ForestModel:
        features, label, rules = self.getOrDefault("featuresCol"), self.getOrDefault("labelCol"), self.rules()
        narrow = materialize(df.select(vector_to_array(F.col(features)).alias("_x"), F.col(label).alias("_y")).where("_y is not null"))
        sample = exact_sample(narrow.withColumn("_key", F.xxhash64("_x", "_y").cast("string")), rules.rows, "_key", rules.seed)
        trees = fit_forest(sample.select(array_to_vector("_x").alias(features), F.col("_y").alias(label)), features, label, rules)
        return ForestModel(base64.b64encode(_packed(trees)).decode(), features)
