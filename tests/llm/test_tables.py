import random

from urlgauge.llm._tables import components


def test_components_both_ways(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (3, 900), (900, 3)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for limit in (1 << 20, 0):
        assert {tuple(r) for r in components(df, limit).collect()} == {(x, root(x)) for x in linked}
        assert components(df.where("a < 0"), limit).count() == 0
