import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from urlgauge.llm.phrase_dedup import op10_query, repeated_phrases
from urlgauge.llm.suffix_dedup import longest_previous_factors, op4_query, repeated_passages, suffix_array, without_repeated_passages

SPACE = rb"[^\x20\x09-\x0D]+"


def brute(docs, window, split, join, keep="none"):
    """(doc, elements, removed, runs, kept) of each document, by counting every window."""
    texts = [(d, split((t or "").encode())) for d, t in docs]
    counts, first = Counter(), {}
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is not None, texts[i][0] or 0))
    for i in order:
        w = texts[i][1]
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window]) if isinstance(w, list) else w[at : at + window]
            counts[key] += 1
            first.setdefault(key, (i, at))
    out = []
    for i, (d, w) in enumerate(texts):
        gone = np.zeros(len(w), bool)
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window]) if isinstance(w, list) else w[at : at + window]
            if counts[key] > 1 and (keep == "none" or first[key] != (i, at)):
                gone[at : at + window] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(w), int(gone.sum()), runs, hashlib.sha256(join([x for x, g in zip(w, gone, strict=True) if not g])).hexdigest()))
    return sorted(out, key=str)


def by_bytes(docs, window, keep="none"):
    return brute(docs, window, lambda b: b, bytes, keep)


def by_words(docs, window, keep="none"):
    return sorted(((d, n, gone, sha) for d, n, gone, _, sha in brute(docs, window, lambda b: re.findall(SPACE, b), b" ".join, keep)), key=str)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got_bytes(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.rest))) for r in df.collect()), key=str)


def got_words(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.rest)) for r in df.collect()), key=str)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "cde", "fghij", "k", "lm", "nopq"]) + rng.choice("rstuvw")
    passage = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passage)[rng.randrange(4) : rng.randrange(8, 41)] if rng.random() < 0.6 else [word() for _ in range(rng.randrange(20))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    docs += [(100, None), (101, ""), (102, " \t"), (103, "a" * 90), (104, "ab " * 60), (105, "ab " * 30 + "x " + "ab " * 31), (None, docs[3][1]), (106, "One. " * 20000)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("group", [2000, 1])
def test_small(spark, seed, keep, group):
    docs = cases(seed)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, row int, seg string").repartition(5)
    assert got_bytes(repeated_passages(df, 20, keep, group)) == by_bytes(docs, 20, keep)
    assert got_words(repeated_phrases(df, 7, keep, group)) == by_words(docs, 7, keep)


def test_repeated_rows(spark):
    text = "one two three four five six seven eight nine"
    docs = [(1, text), (1, text), (2, "zero " + text)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got_bytes(repeated_passages(df, 20, "none")) == by_bytes(docs, 20)
    assert got_words(repeated_phrases(df, 7, "none")) == by_words(docs, 7)
    assert [r.n_removed for r in repeated_passages(df, 20, "first").orderBy("doc_id").collect()][:2] == [0, 0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeated_passages(df).count() == 0 and repeated_phrases(df).count() == 0 and without_repeated_passages(df).count() == 0


def test_stage_keeps_rows_and_columns(spark):
    long = "é" * 300
    df = spark.createDataFrame([(1, long, 300, "a"), (2, "x" + long, 301, "b"), (3, None, None, "c"), (4, "clean", 5, None)], "doc_id bigint, text string, n_chars bigint, row string")
    got = {r.doc_id: r for r in without_repeated_passages(df).collect()}
    assert without_repeated_passages(df).columns == df.columns
    assert len(got) == 4 and len(got[1].text) <= 101 and got[2].text == "x" and got[2].n_chars == 1 and got[3].text is None and got[4].text == "clean"


def test_factors():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 200).astype(np.uint8)
    starts = np.arange(180)
    order, lcp = suffix_array(data, starts, 20)
    best = longest_previous_factors(order, lcp)
    for i in starts:
        want = max([0, *(next((k for k in range(20) if data[i + k] != data[j + k]), 20) for j in range(i))])
        assert best[i] == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_query(spark, folder).collect()), key=str)
    assert got == by_bytes(docs, 200)
    got = sorted((tuple(r) for r in op10_query(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == by_words(docs, 35)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_anchor(spark, keep):
    """One passage, too short to repeat as a whole window, in 10,000 texts with other surroundings."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choice(letters) for _ in range(36))
    words = [rng.choice(letters) + rng.choice(letters) for _ in range(11)]
    sides = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(200)]
    docs = [(i, rng.choice(sides) + "".join(rng.choice(letters) for _ in range(rng.randrange(3))) + passage + rng.choice(sides) + str(i)) for i in range(10_000)]
    by_word = [(i, " ".join([rng.choice(sides), *words, rng.choice(sides), rng.choice(sides), str(i)])) for i in range(10_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert got_bytes(repeated_passages(df, 40, keep)) == by_bytes(docs, 40, keep)
    df = spark.createDataFrame(by_word, "doc_id bigint, text string").repartition(5)
    assert got_words(repeated_phrases(df, 12, keep)) == by_words(by_word, 12, keep)


@pytest.mark.parametrize("size", [10, 11, 12])
def test_words_that_plain_polynomials_confuse(spark, size):
    """The Thue-Morse word and its complement have one hash modulo 2**64, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << size))
    other = one.translate(str.maketrans("ab", "ba"))
    same = [f"w{i}" for i in range(34)]
    docs = [(1, " ".join([*same, one])), (2, " ".join([*same, other])), (3, one), (4, other)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got_words(repeated_phrases(df, 35, "none")) == by_words(docs, 35)
    assert got_bytes(repeated_passages(df, 200, "none")) == by_bytes(docs, 200)
