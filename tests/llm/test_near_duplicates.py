import random
import re

import pytest

from urlgauge.llm.near_duplicates import near_duplicates, op3_query, without_near_duplicates

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    """Every pair that shares a shingle, and union-find."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent, by = {d: d for d, _ in docs}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {(i, j) for of in by.values() for i in of for j in of if i < j}:
        (a, x), (b, y) = sets[i], sets[j]
        if a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), root(d)) for d, s in sets), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_small(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    docs = [(5, " ".join(base)), (3, " ".join(base).upper()), (2, None), (1, ""), (9, " \n\t"), (8, "one two"), (7, "One  two"), (6, "one two three"), (None, "one two"), (11, "one two"), (11, "one two"), (12, "a b c d e f g h"), (12, "q r s")]
    for i in range(40):  # a chain of growing distance, and variants around the threshold
        words = list(base)
        for at in rng.sample(range(60), i // 10):
            words[at] = f"x{i}"
        docs.append((100 + i, " ".join(words)))
    docs.append((200, "long " * 30000))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, n int, key int")
    assert rows(near_duplicates(df)) == brute(docs)
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    # rows are told apart by id and text there, so both unlike texts of 12 stay
    want = [*{d for d, _, c in brute(docs) if d is None or d == c}, 12]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(df).count() == 0 and without_near_duplicates(df).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    got = op3_query(spark, f"/root/testdata/{sf}")
    want = brute([tuple(r) for r in docs.collect()])
    assert rows(got) == want and any(d != c for d, _, c in want)


def test_words_that_plain_polynomials_confuse(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    docs = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba")))], "doc_id bigint, text string")
    assert sorted(r.component_id for r in near_duplicates(docs).collect()) == [1, 2]


def test_unlike_texts_of_one_id_stay(spark):
    words = [f"{c}{i}" for c in "abcdef" for i in range(30)]
    one, other, third = " ".join(words[:40]), " ".join(words[60:100]), " ".join(words[120:160])
    rows = [(1, one, "a"), (1, other, "b"), (2, third, "c"), (3, other + " x", "d"), (2, third, "e"), (None, one, "f"), (4, None, "g"), (4, None, "h"), (5, third + " y", "i"), (5, one + " z", "j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    got = [tuple(r) for r in left.collect()]
    assert {r[2] for r in got} - {"c", "e", "g", "h"} == {"a", "b", "f"}  # d, i and j are near copies of smaller ids
    assert len({"c", "e"} & {r[2] for r in got}) == 1 and len({"g", "h"} & {r[2] for r in got}) == 1


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, kind):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("12", text), ("3", text + " x"), ("7", "some other text that nothing else is like at all"), ("8", None), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {str(r.doc_id): (r.n_shingles, r.component_id) for r in near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast(kind))).collect()}
    least = "12" if kind == "string" else 3
    assert {k: v[1] if v[1] is None else str(v[1]) for k, v in got.items()} == {"12": str(least), "3": str(least), "7": "7", "8": "8", "None": None}
    assert got["8"][0] == 0 and got["3"][0] == 37
