import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from urlgauge.llm import brown
from urlgauge.llm.brown import exchange, fit_brown, op2_query, score_brown


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base_scores(docs, train):
    c = Counter(t for text in train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return n, [(len(w := tokens(t)), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for t in docs]


@pytest.mark.parametrize("held", [1 << 18, 40])
@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_plain_counts(spark, monkeypatch, sf, held):
    monkeypatch.setattr(brown, "HELD_WORDS", held)  # also with most words left to the join
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    n, want = base_scores([t for _, t in rows], [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2])
    got = {r.doc_id: r for r in op2_query(spark, folder).collect()}
    assert len(got) == len(rows)
    for (d, _), (count, known, base) in zip(rows, want, strict=True):
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (count, known, n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)  # logs: nearer to 0 is better


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a d e", "a a b zz", "", None, "f g " * 5]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, word int")
    model = fit_brown(df, classes=3, unit_words=4)
    seen, unseen, discount = model.factors()
    vocabulary = sorted({x for t in texts for x in tokens(t)}, key=str)
    assert model.train_tokens == sum(len(tokens(t)) for t in texts) and model.distinct == len(vocabulary)
    # the probability of each word after one other: score of "first word" less that of its context
    counts = Counter(x for t in texts for x in tokens(t))
    for before in range(len(discount)):
        total = sum(seen[before, k] * (model.tokens[k] - discount[k] * model.types[k]) + unseen[before, k] for k in range(len(discount)))
        total += (1 - brown.MIXED) * (sum(counts.values()) + len(counts) + 1) / model.total()
        assert abs(total - 1) < 1e-9


@pytest.mark.parametrize("held", [1 << 18, 3])
def test_every_training_word_has_a_class_of_its_own_neighbours(spark, monkeypatch, held):
    monkeypatch.setattr(brown, "HELD_WORDS", held)  # also with nearly all words left to the join
    rng = np.random.default_rng(4)
    # nouns and verbs by turns; all rare words end alike, so no ending tells them apart
    nouns, verbs = [f"n{i}xxx" for i in range(40)], [f"v{i}xxx" for i in range(40)]
    pick = lambda often, rare: often if rng.random() < 0.6 else rare[rng.integers(len(rare))]
    texts = [" ".join(x for _ in range(6) for x in ("the", pick("cat", nouns), pick("runs", verbs))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = fit_brown(df, classes=3, unit_words=3)
    hashes = {x: int(brown.T.words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])).hashes[0]) for x in [*nouns, *verbs, "the", "cat", "runs"]}
    of = dict(zip(model.held.tolist(), model.held_classes.tolist(), strict=True)) | {r.word % (1 << 64): r.cls for r in model.rest.collect()}
    kinds = {x: of[h] for x, h in hashes.items()}
    assert {kinds[x] for x in nouns} == {kinds["cat"]} != {kinds["runs"]} == {kinds[x] for x in verbs}
    # the class bigrams and scores are those of a count with these classes
    follow, counts = Counter(), Counter(w for t in texts for w in t.split())
    for t in texts:
        line = [3, *(kinds[w] for w in t.split()), 3]
        follow.update(zip(line, line[1:]))
    total = np.array([*(sum(n for w, n in counts.items() if kinds[w] == k) for k in range(3)), len(texts)])
    table = np.array([[follow[a, b] for b in range(4)] for a in range(4)], float)
    want = (table + brown.SMOOTHING * total / total.sum()) / (table.sum(axis=1, keepdims=True) + brown.SMOOTHING)
    assert np.allclose(model.tokens, total) and np.allclose(model.transition, want)
    n = counts | {None: len(texts)}
    seen, unseen, discount = model.factors()
    text = "the n1xxx v2xxx n3xxx runs the v4xxx"
    line = [(None, 3), *((w, kinds[w]) for w in text.split()), (None, 3)]
    p = [seen[a, k] * (n[w] - discount[k]) + (1 - brown.MIXED) * (n[w] + 1) / model.total() for (_, a), (w, k) in zip(line, line[1:])]
    assert abs(score_brown(spark.createDataFrame([(1, text)], df.schema), model).first().score - np.log10(p).sum()) < 1e-9


def test_score_is_the_sum_over_the_tokens(spark):
    texts = ["a b a c", "b a d e", "a a b zz", "f g " * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    model = fit_brown(df, classes=3, unit_words=4)
    odd = [(1, "A b q"), (1, "A b q"), (2, None), (None, ""), (3, "word " * 30000), (4, "zz")]
    got = score_brown(spark.createDataFrame(odd, df.schema), model).collect()
    assert len(got) == len(odd)
    _, want = base_scores([t for _, t in odd], texts)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == sorted((a, b, round(c, 5)) for a, b, c in want)
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0] == twice[1] and all(r.score < 0 and r.perplexity >= 1 for r in got)


def test_without_training(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    model = fit_brown(df)
    assert score_brown(df, model).count() == 0
    row = score_brown(spark.createDataFrame([(1, "a b")], df.schema), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 3, 30)
    follow = np.array([[0, 1, 0], [0, 0, 1], [1, 0, 0]]) * 50 + 1
    counts = np.zeros((31, 31))
    counts[:30, :30] = rng.poisson(follow[kinds][:, kinds])
    counts[30, 0] = counts[5, 30] = 3
    of = exchange(counts, 3)
    assert all(len({of[u] for u in range(30) if kinds[u] == k}) == 1 for k in range(3)) and (of == of[-1]).sum() == 1


def test_words_that_plain_polynomials_confuse(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(i, f"{one} x") for i in range(20)], "doc_id bigint, text string")
    score = {r.doc_id: r for r in score_brown(spark.createDataFrame([(1, one), (2, other)], docs.schema), fit_brown(docs)).collect()}
    assert (score[1].n_known, score[2].n_known) == (2, 1)


class Sent:
    def __init__(self, value):
        self.value = value


def test_tasks_combine_what_they_find():
    """A key comes once from a task with several batches; each batch gave it anew before."""
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(60)]
    batches = [pa.record_batch([pa.array([" ".join(rng.choice(words, 30)) for _ in range(20)] + [None, ""])], names=["text"]) for _ in range(4)]
    hashes = np.unique(brown.T.words(*brown.T.flat(pa.array([" ".join(words)]))).hashes)
    units, of = hashes[::3], np.append(np.arange(20 + brown.GROUPS) % 5, 5)
    for run, keys in ((brown._pair_counts(Sent(units)), ["pair"]), (brown._neighbours(Sent((units, of))), ["word", "side"])):
        together = pa.Table.from_batches(run(batches)).to_pandas()
        apart = pa.concat_tables(pa.Table.from_batches(run([b])) for b in batches).to_pandas()
        assert not together.duplicated(keys).any() and len(together) < len(apart)
        assert together.groupby(keys).n.sum().equals(apart.groupby(keys).n.sum())
    # what _neighbours gives, sorted by word and cut anywhere, meets again word by word
    gain, found = rng.normal(size=(12, 5)), together.sort_values("word", kind="stable")
    want = np.zeros((len(hashes), 12))
    words, at = np.unique(found.word, return_inverse=True)
    np.add.at(want, (at, found.side), found.n)
    for step in (1, 7, 10**6):
        cut = [pa.RecordBatch.from_pandas(found.iloc[i : i + step], preserve_index=False) for i in range(0, len(found), step)]
        got = pa.Table.from_batches(brown._placed(Sent(gain))([*cut, cut[0].slice(0, 0)])).to_pandas()
        assert got.word.tolist() == words.tolist() and got.n.tolist() == want[: len(words), :6].sum(axis=1).tolist()
        assert got.cls.tolist() == (want[: len(words)] @ gain).argmax(axis=1).tolist()


def test_hashes_are_found_where_they_are():
    rng = np.random.default_rng(6)
    for size in (0, 1, 2, 1000):
        hashes = np.unique(np.concatenate([rng.integers(0, 2**64, size, np.uint64), rng.integers(0, 50, size, np.uint64)]))
        for held in (hashes, np.append(hashes, np.uint64(2**64 - 1))):
            asked = np.concatenate([held, rng.integers(0, 2**64, 500, np.uint64), np.arange(60, dtype=np.uint64), [np.uint64(2**64 - 1)]])
            at, there = brown.T.Places(held)(asked)
            assert there.tolist() == np.isin(asked, held).tolist() and (held[at[there]] == asked[there]).all()
    data = rng.integers(0, 256, 400).astype(np.uint8)
    ends = rng.integers(0, 401, 300)
    starts = np.maximum(ends - rng.integers(0, 4, 300), 0)
    assert (brown.T.short_hashes(data, starts, ends, 3) == brown.T.Hasher(data)(starts, ends)).all()
