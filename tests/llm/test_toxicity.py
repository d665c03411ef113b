from itertools import combinations

import numpy as np
import pytest

from urlgauge.llm.toxicity import (
    DECAY,
    _codes,
    fit_toxicity,
    fit_units,
    landmark_kernels,
    op11_query,
    score_toxicity,
    self_kernels,
    units_of,
)

WORDS = ["\x02abca\x02", "\x02aabb\x02", "\x02xyzxyz\x02", "\x02q\x02", "\x02idiot\x02", "\x02idxiot\x02", "\x02bananabananas"]


def plain_kernel(a, b):
    """The subsequence kernel by its definition: all pairs of equal subsequences of three characters."""
    total = 0.0
    for i in combinations(range(len(a)), 3):
        for j in combinations(range(len(b)), 3):
            if [a[x] for x in i] == [b[x] for x in j]:
                total += DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return total


def test_kernels_follow_the_definition():
    own = self_kernels(_codes(WORDS, 16))
    assert np.allclose(own, [plain_kernel(w, w) for w in WORDS])
    got = landmark_kernels(WORDS, WORDS[:5])
    want = [[plain_kernel(a, b) / np.sqrt(plain_kernel(a, a) * plain_kernel(b, b)) for b in WORDS[:5]] for a in WORDS]
    assert np.allclose(got, want, atol=1e-5)


def _bags():
    rng = np.random.default_rng(4)
    syllables = ["the", "an", "re", "ing", "on", "at", "ed", "is", "or", "ti"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    bags, y = [], []
    for i in range(300):
        sentences = [[word() for _ in range(8)] for _ in range(4)]
        if i % 3 == 0:
            sentences[i % 4][2] = ["blockhead", "numskull", "nitwit"][i % 9 // 3]
        bags.append([[u for w in s for u in units_of(w)] for s in sentences])
        y.append(float(i % 3 == 0))
    return bags, np.array(y)


@pytest.fixture(scope="module")
def model():
    bags, y = _bags()
    return fit_units(bags, y, np.ones(len(y)), landmarks=64)


def test_margin_is_the_sum_over_landmarks(model):
    units = [u for w in ("blockhead", "numskull", "thean", "blxockhead", "zzz", "ééé") for u in units_of(w)]
    want = landmark_kernels(units, model.landmarks) @ model.weights + model.offset
    assert np.allclose(model.margins(units), want, atol=1e-3)


def test_gaps_and_inserted_characters(spark, model):
    texts = ["the blockhead is", "a b-l-o-c-k-h-e-a-d!", "n u m s k u l l at", "the numskulll", "the blockxhead, on", "NITWIT", "the ing on at", "", None, "42 !!", "theblock ating"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert [got[i].predicted for i in range(len(texts))] == [1] * 6 + [0] * 5
    assert got[0].worst == "blockhead" and got[7].worst is None and got[8].score == got[7].score
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op11_query(spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert len(toxic) > 60 and np.mean(toxic) > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.015


def test_odd_tables(spark):
    docs = spark.createDataFrame([("a", "fool " * 3, 1), ("b", "fine", 1), (None, "fool", 1), ("d", None, 1)], "doc_id string, text string, worst int")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("b", 0), (None, 1), ("d", 1), ("x", None)], "doc_id string, toxic int")
    assert fit_toxicity(docs, labels.where("toxic = 0")) is None and fit_toxicity(docs.where("false"), labels) is None
    got = score_toxicity(docs, None)
    assert got.dtypes[0] == ("doc_id", "string") and [r.score for r in got.collect()] == [0.0] * 4
    assert score_toxicity(docs.where("false"), None).count() == 0
    fit_toxicity(docs, labels)  # very few rows do not crash
