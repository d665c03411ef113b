"""Boosted trees against plain versions that know no tasks, histograms by subtraction or batches."""

import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from urlgauge.models.trees import (
    Alone,
    BoostedModel,
    LeafwiseBoosting,
    Rules,
    SecondOrderBoosting,
    _drawn,
    boost,
    drawn_columns,
    edges_of,
    fit_boosted,
    summarise,
    with_rules,
)


def noisy(rows=1500, seed=3, columns=5):
    """A label with an interaction and noise, over columns of few and of many values."""
    rng = np.random.default_rng(seed)
    x = np.stack([np.round(rng.normal(size=rows), 1 + i % 3) if i % 2 else rng.integers(0, 6, rows) for i in range(columns)], axis=1)
    p = 1 / (1 + np.exp(-(2 * (x[:, 1] > 0) * (x[:, 0] > 2) - x[:, 3 % columns] + 0.3 * x[:, 2 % columns] - 0.5)))
    return x.astype(float), (rng.uniform(size=rows) < p).astype(float)


def plain_boost(x, y, rules, keys):
    """One split after the other, every sum anew from the rows, edges from exact quantiles."""
    unit = 2.0**30
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    edges = [edges_of(*np.unique(c, return_counts=True), rules.bins) for c in x.T]
    trees = []
    for nth in range(rules.rounds):
        p = 1 / (1 + np.exp(-margin))
        seen = np.ones(len(y), int) if rules.rows >= 1 else _drawn(keys, np.ones(len(y), int), rules.rows, nth, rules.seed)
        g, h = np.rint((p - y) * unit) / unit * seen, np.rint(p * (1 - p) * unit) / unit * seen
        columns = range(x.shape[1]) if rules.columns >= 1 else drawn_columns(x.shape[1], rules.columns, nth, rules.seed)
        value = lambda m: -rules.rate * g[m].sum() / (h[m].sum() + rules.penalty)  # noqa: B023, E731

        def best(m, depth):
            top = (0.0, None, None)
            if rules.depth and depth >= rules.depth:
                return top
            part = lambda k: g[k].sum() ** 2 / (h[k].sum() + rules.penalty)  # noqa: B023, E731
            for c in columns:  # noqa: B023
                for cut in edges[c]:
                    a, b = m & (x[:, c] <= cut), m & (x[:, c] > cut)
                    if min(seen[a].sum(), seen[b].sum()) < rules.least_rows or min(h[a].sum(), h[b].sum()) < rules.least_curvature:  # noqa: B023
                        continue
                    gain = part(a) + part(b) - part(m)
                    if gain > top[0] + 1e-9:
                        top = (gain, c, cut)
            return top

        nodes = [(np.ones(len(y), bool), 0)]
        splits, open_ = {}, {0: best(*nodes[0])}
        while open_ and (not rules.leaves or len(splits) + 1 < rules.leaves):
            node = max(open_, key=lambda k: (open_[k][0], -k))
            gain, c, cut = open_.pop(node)
            if c is None:
                break
            m, depth = nodes[node]
            splits[node] = (int(c), float(cut))
            for side in (m & (x[:, c] <= cut), m & (x[:, c] > cut)):
                nodes.append((side, depth + 1))
                open_[len(nodes) - 1] = best(side, depth + 1)
        step = np.zeros(len(y))
        for node, (m, _) in enumerate(nodes):
            if node not in splits:
                step[m] = value(m)
        margin = margin + step
        trees.append(splits)
    return margin, trees


RULES = [
    Rules(rounds=6, rate=0.3, leaves=12, least_rows=20),
    Rules(rounds=5, rate=0.3, depth=4, rows=0.8, columns=0.8, penalty=1.0, least_curvature=1.0, bins=64),
]


def splits_of(tree):
    return {i: (c, tree.cut[i]) for i, c in enumerate(tree.column) if c >= 0}


@pytest.mark.parametrize("rules", RULES)
def test_tree_by_tree_equal_to_a_plain_version(rules):
    x, y = noisy(700)
    keys = np.arange(len(y)) * 7919
    base, trees = boost(x, y, np.ones(len(y), np.int64), keys, Alone(), rules)
    margin, plain = plain_boost(x, y, rules, keys)
    assert [splits_of(t) for t in trees] == plain
    assert np.allclose(base + sum(t.scores(x) for t in trees), margin, atol=1e-9)
    assert max(t.leaves() for t in trees) > 8


class Tasks(Alone):
    """Tasks of one fit as threads, to see that their trees do not depend on how rows are dealt."""

    def __init__(self, board, nth):
        self.board, self.nth = board, nth

    def all(self, own):
        barrier, slots = self.board
        slots[self.nth] = own
        barrier.wait()
        out = list(slots)
        barrier.wait()
        return out


def test_same_trees_for_any_dealing():
    x, y = noisy(900)
    rules = Rules(rounds=4, rate=0.2, leaves=16, rows=0.7, least_rows=5)
    keys, ones = np.arange(len(y)) * 31, np.ones(len(y), np.int64)
    want = [vars(t) for t in boost(x, y, ones, keys, Alone(), rules)[1]]
    part = np.random.default_rng(1).integers(0, 3, len(y))  # and a fourth task without rows
    board, got = (threading.Barrier(4), [None] * 4), {}

    def run(k):
        own = part == k
        got[k] = [vars(t) for t in boost(x[own], y[own], ones[own], keys[own], Tasks(board, k), rules)[1]]

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert all(got[k] == want for k in range(4))


def test_repeated_rows_are_weights():
    x, y = noisy(300)
    rules = Rules(rounds=3, rate=0.3, leaves=8, least_rows=10)
    both, counts = np.unique(np.column_stack([x, y])[np.arange(900) % 300], axis=0, return_counts=True)
    one = boost(both[:, :-1], both[:, -1], counts, np.arange(len(both)), Alone(), rules)[1]
    many = boost(np.tile(x, (3, 1)), np.tile(y, 3), np.ones(900, np.int64), np.arange(900), Alone(), rules)[1]
    assert [splits_of(t) for t in one] == [splits_of(t) for t in many]


def test_summaries_merge_within_their_bound():
    rng = np.random.default_rng(6)
    values, weights = np.concatenate([rng.lognormal(size=30_000), np.full(9_000, 1.5)]), rng.uniform(0.1, 2, 39_000)
    parts = [summarise(values[i::7], weights[i::7], 200) for i in range(7)]
    points, steps = summarise(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]), 200)
    total = weights.sum()
    order = np.argsort(values)
    upto = np.cumsum(weights[order])
    for value, known in zip(points, np.cumsum(steps), strict=True):
        true = upto[np.searchsorted(values[order], value, side="right") - 1]
        assert abs(known - true) <= 2 * total / 200
    edges = edges_of(points, steps, 32)
    assert 1.5 in edges and len(edges) <= 31
    between = np.diff([0, *(weights[values <= e].sum() for e in edges), total])
    heavy = np.array([weights[values == e].sum() for e in [*edges, 0]])
    assert (between - heavy <= total / 32 + 5 * total / 200).all()
    assert summarise(values[:0], weights[:0])[0].size == 0 and edges_of(np.array([4.0]), np.array([1.0]), 8).size == 0


def _table(spark, x, y):
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], [*names, "label"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


@pytest.mark.parametrize("rules", RULES)
def test_tasks_of_a_barrier_stage_agree(spark, rules):
    df = _table(spark, *noisy(400))
    want = fit_boosted(df, "features", "label", rules, tasks=1)
    got = fit_boosted(df.repartition(5), "features", "label", rules, tasks=3)
    assert want[0] == got[0] and [vars(t) for t in want[1]] == [vars(t) for t in got[1]]


def test_learners_in_a_pipeline(spark, tmp_path):
    x, y = noisy(3000, seed=9)
    train, test = _table(spark, x[:2000], y[:2000]), _table(spark, x[2000:], y[2000:])
    for learner in (with_rules(LeafwiseBoosting(), rounds=60), with_rules(SecondOrderBoosting(), rounds=40)):
        model = learner.fit(train)
        trees = model.all_trees()
        assert len(trees) == learner.rules().rounds
        assert max(t.leaves() for t in trees) <= (learner.rules().leaves or 128) and max(t.depth() for t in trees) <= (learner.rules().depth or 99)
        rows = model.transform(test).select("label", "prediction", "probability").collect()
        right = np.mean([r.label == r.prediction for r in rows])
        oracle = np.mean(y[2000:] == (noisy_share(x[2000:]) > 0.5))
        assert oracle - 0.06 < right <= 1
        assert all(abs(r.probability[1] - r.prediction) <= 0.5 for r in rows)
    path = str(tmp_path / "model")
    model.write().save(path)
    again = BoostedModel.load(path)
    assert again.transform(test).select("prediction").collect() == model.transform(test).select("prediction").collect()
    assert LeafwiseBoosting().rules() == Rules(rounds=500, rate=0.05, leaves=64, least_rows=20)


def noisy_share(x):
    return 1 / (1 + np.exp(-(2 * (x[:, 1] > 0) * (x[:, 0] > 2) - x[:, 3] + 0.3 * x[:, 2] - 0.5)))


def test_one_class_and_no_rows(spark):
    df = _table(spark, *noisy(50)).drop("label")
    from pyspark.sql import functions as F

    base, trees = fit_boosted(df.withColumn("label", F.lit(1)), "features", "label", Rules(rounds=2, rate=0.1))
    assert base > 10 and all(t.leaves() == 1 for t in trees)
    with pytest.raises(ValueError):
        fit_boosted(df.withColumn("label", F.lit(None).cast("int")), "features", "label", Rules(rounds=2, rate=0.1))
