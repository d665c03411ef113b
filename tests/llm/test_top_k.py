import numpy as np
import pytest

from urlgauge.llm.top_k import op9_query, quantised, top_k


def brute(rows, k=10, every=100):
    """rows: (id, vector or None)."""
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            known.setdefault(i, set()).add(tuple(int(np.floor(1024.0 * float(x))) for x in v))
    out = []
    for i, forms in known.items():
        if i % every == 0:
            best = {}
            for a in forms:
                for j, others in known.items():
                    for b in others:
                        if i != j and len(a) == len(b):
                            s = sum(x * y for x, y in zip(a, b, strict=True))
                            best[j] = max(best.get(j, s), s)
            out += [(i, n, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [32 << 20, 2000])
def test_small(spark, query_bytes):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.5, 0.0, 0.0]) for i in range(300, 420)]  # ties
    rows += [(500, None), (600, [None, 1.0]), (700, [float("nan")] * 6), (800, [float("inf")] * 6), (900, []), (1000, []), (1001, [2.0, 3.0]), (1100, [1.0, -1.0]), (None, [1.0] * 6)]
    rows += [rows[0], rows[100], (200, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int").repartition(4)
    q = quantised(df)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in top_k(q, q.where("vec_id % 100 = 0"), query_bytes=query_bytes).collect())
    assert got == brute(rows)


def test_empty(spark):
    q = quantised(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert top_k(q, q).count() == 0
    one = quantised(spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>"))
    assert top_k(one, one).count() == 0


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in op9_query(spark, sf_dir).collect()) == brute(rows)


def test_an_id_with_many_vectors_counts_once_in_a_task():
    from urlgauge.llm.top_k import _Best

    best = _Best(3, np.full(1, np.iinfo(np.int64).min + 1))
    ids = np.array([7, 7, 7, 7, 1, 2, 3])
    best.add(np.zeros(7, np.int64), ids, np.array([90, 80, 70, 60, 50, 40, 30]))
    query, ids, scores = best.settle()
    assert ids.tolist() == [7, 1, 2] and scores.tolist() == [90, 50, 40] and best.least[0] == 40
