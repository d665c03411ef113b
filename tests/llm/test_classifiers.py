import numpy as np
import pytest

from urlgauge.llm.language import fit_language, known_language, op7_query, predict_language
from urlgauge.llm.quality import FEATURES, features, fit_additive, fit_quality, op1_query, score_quality

ODD = [(1, None), (2, ""), (3, "123 !? €"), (4, "é"), (5, "the " * 50000), (6, "the cat"), (6, "the cat"), (None, "the dog and the man")]


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op7_query(spark, folder).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    train = [(i, t, k, "x") for i in range(40) for t, k in (("the man and the dog", "en"), ("der Mann und der Hund", "de"), ("niemand", None))]
    docs = spark.createDataFrame([(3 * n, *t[1:]) for n, t in enumerate(train)], "doc_id bigint, text string, lang string, score string")
    model = fit_language(docs)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(*o, 0.5) for o in ODD], "doc_id bigint, text string, score double")
    got = predict_language(odd, model).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred != "und" and by[5].lang_pred == "en"
    kept = known_language(odd, model)
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})


def test_language_without_labels(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert fit_language(docs) is None and predict_language(docs, None).count() == 0 and known_language(docs, None).count() == 0
    assert predict_language(spark.createDataFrame([(1, "x", None)], docs.schema), None).first()[1:] == ("und", 0.0, False)


@pytest.mark.parametrize("known", [["en"], ["en", "fr"], ["de", "en", "es"], ["de", "en", "es", "fr"]])
def test_texts_of_no_known_language_are_rejected(spark, known):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language(docs.where(docs.lang.isin(known)))
    rng = np.random.default_rng(3)
    odd = ["".join(map(chr, rng.integers(97, 123, 400))), " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(80))]
    odd += ["Это русский текст, который модель никогда не видела. " * 4, "Ten tekst jest napisany po polsku i nie powinien tu pozostać, bo model go nie zna. " * 3]
    odd += ["for i in range(len(xs)):\n    if xs[i] is None:\n        return foo.bar(xs, i + 1)\n" * 4]
    noise = spark.createDataFrame([(-1 - i, x, "odd") for i, x in enumerate(odd)], docs.schema)
    rows = predict_language(docs.union(noise), model).join(docs.union(noise), "doc_id").where("doc_id < 0 or crc32(cast(doc_id as string)) % 4 = 2").collect()
    share = lambda of: np.mean([r.accepted for r in rows if of(r.lang)])
    assert share(lambda x: x in known) > 0.98 and share(lambda x: x == "odd") == 0
    if len(known) < 4:
        assert share(lambda x: x not in [*known, "odd"]) < 0.02


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op1_query(spark, folder).join(labels, "doc_id").where("held_out").collect()
    good = np.mean([r.predicted == 1 for r in rows if r.quality == 1])
    bad = np.mean([r.predicted == 0 for r in rows if r.quality == 0])
    assert good > 0.98 and bad > 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("fine words here " if i % 2 else "BAD!! $$$ ") * (i % 7 + 1), "x") for i in range(200)] + [(900, None, "x")], "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(5, 1, 0), (7, None, 0), (None, 1, 0), (900, 1, 1), (5000, 0, 1)], "doc_id bigint, quality int, text int")
    model = fit_quality(docs, labels)
    got = score_quality(spark.createDataFrame([(*o, 0.5) for o in ODD], "doc_id bigint, text string, score double"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert fit_quality(docs.where("doc_id < 0"), labels) is None and fit_quality(docs, labels.where("doc_id < 0")) is None
    assert score_quality(docs.where("doc_id < 0"), model).count() == 0


def test_features():
    data = np.frombuffer(b"aa aa BB!! x", np.uint8)
    x = dict(zip(FEATURES, features(data, np.array([0, 12, 12]))[0], strict=True))
    assert x["word_bytes"] == 9 / 4 and x["word_again"] == 0.25 and x["share_upper"] == 2 / 12 and x["distinct_words"] == 0.75 and x["top_word"] == 0.5
    assert not features(data, np.array([0, 12, 12]))[1].any()


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_learn_what_single_features_cannot(seed):
    x = np.random.default_rng(seed).uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = fit_additive(x, y, np.ones(len(y)), rounds=200)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == (y == 1)) > 0.9
