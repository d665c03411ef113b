"""Forests without a depth limit, in one phase and in two."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from urlgauge.models.forest import DeepForest, ForestModel, ForestRules, copies, finish, fit_forest


def table(spark, x, y):
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], [*names, "label"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def plain_depth(x, y):
    """Levels a tree of the purest cuts needs on one column, one cut after the other."""
    if len(set(y)) < 2 or len(set(x)) < 2:
        return 0
    best = None
    for cut in sorted(set(x))[:-1]:
        a, b = y[x <= cut], y[x > cut]
        gain = sum((v.sum() ** 2 + (len(v) - v.sum()) ** 2) / len(v) for v in (a, b))
        if best is None or gain > best[0] + 1e-12:
            best = (gain, cut)
    m = x <= best[1]
    return 1 + max(plain_depth(x[m], y[m]), plain_depth(x[~m], y[~m]))


def chain():
    x = np.arange(140.0)
    return x[:, None], x % 2


def test_chain_needs_sixty_levels(spark):
    x, y = chain()
    deep = plain_depth(x[:, 0], y)
    assert deep >= 60
    (tree,) = fit_forest(table(spark, x, y), "features", "label", ForestRules(trees=1, bootstrap=False))
    assert tree.depth() == deep and ((tree.scores(x) > 0.5) == (y > 0)).all()


@pytest.mark.parametrize("node_rows", [40, 300])
def test_two_phases_learn_what_one_does(spark, node_rows):
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 50, 1200), rng.normal(size=1200), rng.integers(0, 3, 1200), np.full(1200, 5)], axis=1).astype(float)
    y = ((x[:, 0] % 7 < 3) != (x[:, 1] > 0.2)).astype(float)
    rules = ForestRules(trees=3, bootstrap=False, node_rows=node_rows)
    trees = fit_forest(table(spark, x, y).repartition(6), "features", "label", rules)
    assert all(((t.scores(x) > 0.5) == (y > 0)).all() for t in trees)  # every leaf is pure
    again = fit_forest(table(spark, x, y).repartition(2), "features", "label", rules)
    assert [sorted(t.cut) for t in trees] == [sorted(t.cut) for t in again]
    # the first split is the purest of the columns drawn for it, on the bins
    assert len({t.column[0] for t in trees} - {-1}) >= 1


def test_finished_subtrees_are_pure_and_weighted():
    x = np.array([[0.0], [0.0], [1.0], [1.0]])
    tree = finish(x, np.array([0.0, 1.0, 1.0, 0.0]), np.array([3, 1, 5, 0]), (1,), 1)
    assert tree.leaves() == 2 and sorted(tree.value[1:]) == [0.25, 1.0]
    assert finish(x, np.ones(4), np.ones(4), (1,), 1).leaves() == 1
    near = np.array([[1.0], [np.nextafter(1.0, 2)]])
    assert finish(near, np.array([0.0, 1.0]), np.ones(2), (1,), 1).leaves() == 2


def test_sample_copies():
    keys = np.arange(40_000) * 2654435761
    for count in (1, 5, 200):
        drawn = copies(keys, np.full(len(keys), count), 3, ForestRules())
        assert abs(drawn.mean() - count) < 0.03 * count + 0.01 and abs(drawn.var() - count) < 0.06 * count + 0.02
    assert (copies(keys, np.full(len(keys), 1), 3, ForestRules()) != copies(keys, np.full(len(keys), 1), 4, ForestRules())).any()
    assert abs((copies(keys, np.full(len(keys), 1), 3, ForestRules()) == 0).mean() - np.exp(-1)) < 0.01


def test_learner(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 5)).round(1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.uniform(size=900) < 0.1)).astype(int)
    train, test = table(spark, x[:600], y[:600]), table(spark, x[600:], y[600:])
    import json
    from dataclasses import asdict

    learner = DeepForest(settings=json.dumps(asdict(ForestRules(trees=40, node_rows=200))))
    model = learner.fit(train)
    rows = model.transform(test).select("label", "prediction", "probability").collect()
    assert np.mean([r.label == r.prediction for r in rows]) > 0.75 and len(model.all_trees()) == 40
    assert all(0 <= r.probability[1] <= 1 for r in rows)
    model.write().save(str(tmp_path / "m"))
    assert ForestModel.load(str(tmp_path / "m")).transform(test).select("prediction").collect() == [(r.prediction,) for r in rows]
    assert DeepForest().rules() == ForestRules(trees=200) and ForestRules().depth == 0
    shallow = fit_forest(train, "features", "label", ForestRules(trees=4, depth=3, node_rows=100))
    assert max(t.depth() for t in shallow) == 3
    with pytest.raises(ValueError):
        fit_forest(train.where("label > 5"), "features", "label", ForestRules())
