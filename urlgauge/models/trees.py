"""Boosted trees with histograms, grown best leaf first or to a depth, in one barrier stage.

Equal rows are first counted, so a row that makes up a third of the table is one row with a weight. Then a few tasks hold
the counted rows as small integers (bins) and grow all trees together: each adds up its own gradients and curvatures per
leaf, column and bin, the tasks exchange these histograms (`BarrierTaskContext.allGather`), and every task takes the same
split. Sums are integers (fixed point), so the trees do not depend on how rows were dealt. Of two children only the
smaller one is added up; its sibling is the parent less that. A lost executor restarts the stage.

Bin edges come from quantile summaries, weighted by curvature, that each task makes of its own rows and that merge with
a known error.
"""

from __future__ import annotations

import base64
import heapq
import json
import pickle
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.session import materialize

#: Gradients and curvatures are counted in units of 2**-SCALE.
SCALE = 30
#: Points of a column's quantile summary: ranks are known to 1/SUMMARY of all weight after a merge.
SUMMARY = 2_048
#: Different rows that one task holds as a rule; tasks are never more than the cluster can run at once.
TASK_ROWS = 200_000


@dataclass(frozen=True)
class Rules:
    """How trees grow. leaves and depth: 0 for no limit; rows and columns: the shares drawn for each tree."""

    rounds: int
    rate: float
    leaves: int = 0
    depth: int = 0
    bins: int = 255
    rows: float = 1.0
    columns: float = 1.0
    penalty: float = 0.0
    least_gain: float = 0.0
    least_rows: int = 1
    least_curvature: float = 1e-3
    seed: int = 42


@dataclass
class Tree:
    """Nodes in order of creation: column (-1: leaf), cut (left: value <= cut), children, value and gain."""

    column: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    @classmethod
    def stump(cls) -> Tree:
        return cls([-1], [0.0], [-1], [-1], [0.0], [0.0])

    def split(self, node: int, column: int, cut: float, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        children = len(self.column), len(self.column) + 1
        self.column[node], self.cut[node], self.gain[node] = column, cut, gain
        self.left[node], self.right[node] = children
        for value in values:
            for own, new in zip((self.column, self.cut, self.left, self.right, self.value, self.gain), (-1, 0.0, -1, -1, value, 0.0), strict=True):
                own.append(new)
        return children

    def leaves(self) -> int:
        return sum(c < 0 for c in self.column)

    def depth(self) -> int:
        levels = [0] * len(self.column)
        for node, column in enumerate(self.column):
            if column >= 0:
                levels[self.left[node]] = levels[self.right[node]] = levels[node] + 1
        return max(levels)

    def scores(self, x: np.ndarray) -> np.ndarray:
        column, cut = np.array(self.column), np.array(self.cut)
        child = np.stack([self.right, self.left])
        node = np.zeros(len(x), np.int64)
        active = np.arange(len(x)) if column[0] >= 0 else np.zeros(0, np.int64)
        while len(active):
            at = node[active]
            node[active] = child[(x[active, column[at]] <= cut[at]).astype(np.int64), at]
            active = active[column[node[active]] >= 0]
        return np.array(self.value)[node]


# --- quantile summaries ------------------------------------------------------


def summarise(values: np.ndarray, weights: np.ndarray, points: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Rising values and the weight up to each since the one before; no step but a single value's is above 1/points.

    So the weight up to any value is known to 1/points of the whole. Summaries of parts are merged by putting them
    together and summarising again, which adds another 1/points.
    """
    values, which = np.unique(values, return_inverse=True)
    weights = np.bincount(which, weights, len(values)) if len(values) else np.zeros(0)
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    step = np.floor(upto / upto[-1] * points)
    last = np.append(step[1:] != step[:-1], True)
    # a value that is heavy on its own stands alone: it closes its step, and so does the one before it
    heavy = weights > upto[-1] / points
    last |= heavy
    last[:-1] |= heavy[1:]
    return values[last], np.diff(np.concatenate([[0.0], upto[last]]))


def edges_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins-1 edges (bin: number of edges below the value) with about equal weight between them."""
    if len(values) <= bins:
        return values[:-1]
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)
    return np.unique(values[np.minimum(at, len(values) - 2)])


# --- the tasks of one fit ------------------------------------------------------


class Alone:
    """Exchange between the tasks of a fit when there is one."""

    def all(self, own) -> list:
        return [own]

    def total(self, own: np.ndarray) -> np.ndarray:
        return np.sum(self.all(own), axis=0)


class Together(Alone):
    def __init__(self, context: BarrierTaskContext):
        self.context = context

    def all(self, own) -> list:
        message = base64.b64encode(zlib.compress(pickle.dumps(own), 1)).decode()
        return [pickle.loads(zlib.decompress(base64.b64decode(m))) for m in self.context.allGather(message)]  # noqa: S301


@dataclass
class Leaf:
    """A leaf on its way: own rows, histogram of all tasks, its best split, and its children once they are known."""

    rows: np.ndarray
    sums: np.ndarray
    depth: int
    gain: float = -1.0
    column: int = -1
    bin: int = -1
    children: tuple[Leaf, Leaf] | None = None


def _histogram(bins: np.ndarray, stats: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """columns x bins x (gradient, curvature, rows) of some rows, as exact integers."""
    out = np.zeros((bins.shape[1], size, 3), np.int64)
    own = stats[rows]
    for column in range(bins.shape[1]):
        at = bins[rows, column]
        for k in range(3):  # two halves each below 2**53, so that float sums are exact
            high, low = own[:, k] >> 24, own[:, k] & 0xFFFFFF
            out[column, :, k] = (np.bincount(at, high, size).astype(np.int64) << 24) + np.bincount(at, low, size).astype(np.int64)
    return out


def _best(leaf: Leaf, rules: Rules, columns: np.ndarray) -> None:
    """The split of the highest gain; ties go to the first column and the lowest cut."""
    unit = 2.0**-SCALE
    whole = leaf.sums[0].sum(axis=0)
    left = np.cumsum(leaf.sums[columns], axis=1)[:, :-1]
    right = whole - left
    g, h = whole[0] * unit, whole[1] * unit
    part = lambda s: (s[..., 0] * unit) ** 2 / np.maximum(s[..., 1] * unit + rules.penalty, 1e-12)
    gain = part(left) + part(right) - g * g / max(h + rules.penalty, 1e-12)
    low = np.minimum(left[..., 2], right[..., 2]) >= max(rules.least_rows, 1)
    ok = low & (np.minimum(left[..., 1], right[..., 1]) * unit >= rules.least_curvature)
    gain = np.where(ok, gain, -1.0)
    at = int(np.argmax(gain)) if gain.size else 0
    if gain.size and gain.flat[at] > rules.least_gain:
        leaf.gain, leaf.column, leaf.bin = float(gain.flat[at]), int(columns[at // gain.shape[1]]), at % gain.shape[1]


def _value(sums: np.ndarray, rules: Rules) -> float:
    g, h, _ = sums[0].sum(axis=0) * 2.0**-SCALE
    return float(-rules.rate * g / max(h + rules.penalty, 1e-12))


def _expand(leaves: list[Leaf], bins: np.ndarray, stats: np.ndarray, group: Alone, rules: Rules, columns: np.ndarray) -> None:
    """Children of some leaves, with one exchange for all of them."""
    size = leaves[0].sums.shape[1]
    sides, smaller = [], []
    for leaf in leaves:
        goes_left = bins[leaf.rows, leaf.column] <= leaf.bin
        sides.append((leaf.rows[goes_left], leaf.rows[~goes_left]))
        left = leaf.sums[leaf.column, : leaf.bin + 1, 2].sum()
        smaller.append(0 if left * 2 <= leaf.sums[leaf.column, :, 2].sum() else 1)
    own = np.stack([_histogram(bins, stats, s[k], size) for s, k in zip(sides, smaller, strict=True)])
    for leaf, side, k, sums in zip(leaves, sides, smaller, group.total(own), strict=True):
        pair = (sums, leaf.sums - sums) if k == 0 else (leaf.sums - sums, sums)
        leaf.children = tuple(Leaf(r, s, leaf.depth + 1) for r, s in zip(side, pair, strict=True))
        for child in leaf.children:
            if not rules.depth or child.depth < rules.depth:
                _best(child, rules, columns)


def grow(bins: np.ndarray, stats: np.ndarray, edges: list[np.ndarray], group: Alone, rules: Rules, columns: np.ndarray) -> tuple[Tree, list[tuple[int, np.ndarray]]]:
    """A tree, always splitting the leaf of the highest gain (ties: the older one); and (node, own rows) of its leaves.

    Leaves that will be split whatever their children are like are expanded together, so a tree takes about as many
    exchanges as it is deep, not one for each split.
    """
    size = max((len(e) + 1 for e in edges), default=1)
    rows = np.flatnonzero(stats[:, 2] > 0)
    root = Leaf(rows, group.total(_histogram(bins, stats, rows, size)), 0)
    _best(root, rules, columns)
    tree = Tree.stump()
    tree.value[0] = _value(root.sums, rules)
    queue, done, count = [(-root.gain, 0, root)], [], 1
    while queue:
        gain, node, leaf = heapq.heappop(queue)
        if -gain <= rules.least_gain or leaf.column < 0 or (rules.leaves and count >= rules.leaves):
            done.append((node, leaf.rows))
            continue
        if leaf.children is None:
            room = rules.leaves - count if rules.leaves else len(queue) + 1
            first = heapq.nsmallest(room - 1, queue, key=lambda x: x[:2]) if room > 1 else []
            wanted = [leaf, *(x[2] for x in first if x[2].column >= 0 and x[2].children is None)]
            _expand(wanted, bins, stats, group, rules, columns)
        cut = float(edges[leaf.column][leaf.bin])
        nodes = tree.split(node, leaf.column, cut, leaf.gain, tuple(_value(c.sums, rules) for c in leaf.children))
        count += 1
        for child_node, child in zip(nodes, leaf.children, strict=True):
            heapq.heappush(queue, (-child.gain, child_node, child))
    return tree, done


def _uniform(keys: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the keys and salts only."""
    h = keys.astype(np.uint64)
    for salt in salts:
        h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _drawn(keys: np.ndarray, counts: np.ndarray, share: float, salt: int, seed: int) -> np.ndarray:
    """How many of each row's copies a tree sees, each copy drawn for itself; of many copies their share, rounded at random."""
    out = np.floor(counts * share + _uniform(keys, seed, salt, 0)).astype(np.int64)
    few = np.flatnonzero(counts <= 64)
    out[few] = 0
    for nth in range(int(counts[few].max(initial=0))):
        some = few[counts[few] > nth]
        out[some] += _uniform(keys[some], seed, salt, nth + 1) < share
    return out


def drawn_columns(count: int, share: float, salt: int, seed: int) -> np.ndarray:
    """The columns of one tree."""
    wanted = max(int(share * count), 1)
    order = np.argsort(_uniform(np.arange(count), seed, salt), kind="stable")
    return np.sort(order[:wanted])


def boost(x: np.ndarray, y: np.ndarray, counts: np.ndarray, keys: np.ndarray, group: Alone, rules: Rules) -> tuple[float, list[Tree]]:
    """Base margin and trees for the rows of all tasks of the group. Every task gets the same."""
    positive, total = group.total(np.array([(y * counts).sum(), counts.sum()], np.int64))
    share = float(np.clip(positive / max(total, 1), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    curvature = counts * (share * (1 - share))
    edges = []
    for column in zip(*group.all([summarise(c, curvature) for c in x.T]), strict=True):
        merged = summarise(np.concatenate([v for v, _ in column]), np.concatenate([w for _, w in column]))
        edges.append(edges_of(*merged, rules.bins))
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(edges) else np.zeros((len(x), 0), np.int64)
    margin, trees = np.full(len(y), base), []
    for nth in range(rules.rounds):
        p = 1 / (1 + np.exp(-margin))
        seen = counts if rules.rows >= 1 else _drawn(keys, counts, rules.rows, nth, rules.seed)
        fixed = lambda v: np.rint(v * 2.0**SCALE).astype(np.int64) * seen  # noqa: B023, E731
        stats = np.stack([fixed(p - y), fixed(p * (1 - p)), seen], axis=1)
        columns = np.arange(x.shape[1]) if rules.columns >= 1 else drawn_columns(x.shape[1], rules.columns, nth, rules.seed)
        tree, leaves = grow(bins, stats, edges, group, rules, columns)
        trees.append(tree)
        if rules.rows >= 1:
            for node, rows in leaves:
                margin[rows] += tree.value[node]
        else:
            margin += tree.scores(x)
    return base, trees


# --- Spark ----------------------------------------------------------------------


def counted_rows(df: DataFrame, features: str, label: str) -> DataFrame:
    """(x, y, n, key): different rows with how often each occurs, and a hash of their content."""
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    counted = rows.where("y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    return counted.select("x", "y", "n", F.xxhash64("x", "y").alias("key"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat, np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def fit_boosted(df: DataFrame, features: str, label: str, rules: Rules, tasks: int | None = None) -> tuple[float, list[Tree]]:
    """Base margin and trees of a table with a vector column and a 0/1 label; null labels are left out."""
    spark = df.sparkSession
    rows = materialize(counted_rows(df, features, label))
    total = rows.count()
    if not total:
        raise ValueError("no labelled rows")
    width = len(rows.first()["x"])
    most = spark.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(most, -(-total // TASK_ROWS)))

    def train(batches):
        context = BarrierTaskContext.get()
        # sums are exact, so neither the order of rows nor the way they are dealt matters
        parts = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(parts) if parts else None
        n = table.num_rows if table else 0
        x = _matrix(table.column(0), n) if n else np.zeros((0, width))
        number = lambda i, kind: np.asarray(table.column(i)).astype(kind) if n else np.zeros(0, kind)
        group = Together(context) if len(context.getTaskInfos()) > 1 else Alone()
        base, trees = boost(x, number(1, np.float64), number(2, np.int64), number(3, np.int64), group, rules)
        if context.partitionId() == 0:
            yield pa.record_batch([pa.array([base]), pa.array([dump_trees(trees)])], names=["base", "trees"])

    found = rows.repartition(tasks).mapInArrow(train, "base double, trees string", barrier=True).collect()
    return found[0]["base"], load_trees(found[0]["trees"])


def dump_trees(trees: Sequence[Tree]) -> str:
    return json.dumps([vars(t) for t in trees])


def load_trees(text: str) -> list[Tree]:
    return [Tree(**t) for t in json.loads(text)]


class _Shared(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 column", TypeConverters.toString)


class BoostedModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction, like MLlib's classifiers."""

    base = Param(Params._dummy(), "base", "margin before the first tree", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "trees as JSON", TypeConverters.toString)

    def __init__(self, base: float = 0.0, trees: str = "[]", featuresCol: str = "features"):
        super().__init__()
        self._set(base=base, trees=trees, featuresCol=featuresCol)

    def all_trees(self) -> list[Tree]:
        return load_trees(self.getOrDefault("trees"))

    def _transform(self, df: DataFrame) -> DataFrame:
        base = self.getOrDefault("base")
        sent = df.sparkSession.sparkContext.broadcast(self.all_trees())  # bounded by rounds and leaves

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.stack(x.to_numpy())
            return pd.Series(base + sum((t.scores(rows) for t in sent.value), np.zeros(len(rows))))

        return with_margin(df, margin(vector_to_array(F.col(self.getOrDefault("featuresCol")))))


def with_margin(df: DataFrame, margin) -> DataFrame:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin")))
    out = df.withColumn("_margin", margin)
    return out.select(
        *df.columns,
        array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))).alias("rawPrediction"),
        array_to_vector(F.array(1 - p, p)).alias("probability"),
        (p > 0.5).cast("double").alias("prediction"),
    )


class _Boosted(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    settings = Param(Params._dummy(), "settings", "rules as JSON", TypeConverters.toString)

    def rules(self) -> Rules:
        return Rules(**json.loads(self.getOrDefault("settings")))

    def _fit(self, df: DataFrame) -> BoostedModel:
        base, trees = fit_boosted(df, self.getOrDefault("featuresCol"), self.getOrDefault("labelCol"), self.rules())
        return BoostedModel(base, dump_trees(trees), self.getOrDefault("featuresCol"))


class LeafwiseBoosting(_Boosted):
    """500 slow rounds of trees with 64 leaves, always splitting the leaf that gains most."""

    # The settings of the leaf-wise learner.
    RULES = Rules(rounds=500, rate=0.05, leaves=64, least_rows=20)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", settings=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, settings=settings or json.dumps(vars(self.RULES)))


class SecondOrderBoosting(_Boosted):
    """300 rounds of depth 7 with a penalty on leaf values, each on 80 % of the rows and columns."""

    # The settings of the second-order learner.
    RULES = Rules(rounds=300, rate=0.1, depth=7, bins=256, rows=0.8, columns=0.8, penalty=1.0, least_curvature=1.0)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", settings=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, settings=settings or json.dumps(vars(self.RULES)))


def with_rules(learner: _Boosted, **changes) -> _Boosted:
    """The learner with some of its rules changed."""
    return learner.copy({learner.settings: json.dumps(vars(replace(learner.rules(), **changes)))})
