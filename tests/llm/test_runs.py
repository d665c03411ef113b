import hashlib
import zlib
from itertools import groupby

import numpy as np
import pytest

from urlgauge.llm.runs import Wavelet, find_runs, op13_query, periodic_runs

SPACE = " \t\n\v\f\r"


def plain_runs(words, least=24):
    """Every maximal stretch of every period, of which the smallest period of each stretch counts."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        for same, group in groupby(words[k] == words[k + q] for k in range(len(words) - q)):
            n = len(list(group))
            if same and n + q >= max(least, 3 * q):
                found.setdefault((i, n + q), q)
            i += n
    return sorted((s, n, q) for (s, n), q in found.items())


def texts():
    rng = np.random.default_rng(5)
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab" * 12), list("ab" * 11 + "a"), list("aab" * 40 + "c" + "aab" * 40)]
    out += [list("a" * 30 + "b") * 5, (list("aab" * 9) + ["c"]) * 6, (["x"] * 40 + ["y"] * 41) * 4 + ["x"] * 60, list("ab" * 64 + "c") * 4 + list("ab" * 30)]
    for _ in range(300):
        text = []
        while len(text) < rng.integers(1, 400):
            word = rng.integers(0, rng.integers(1, 4), rng.integers(1, rng.choice([4, 12, 60]))).tolist()
            text += (word * int(rng.integers(1, 12)))[: int(rng.integers(1, 300))]
            if len(out) % 3 == 0:  # runs within runs
                text = text[-40:] * int(rng.integers(1, 5))
        out.append([str(x) for x in text])
    return out


def test_equal_to_brute_force():
    given = texts()
    rows = np.repeat(np.arange(len(given)), [len(t) for t in given])
    words = np.array([hash(w) & 0xFFFF for t in given for w in t], np.uint64)
    place, length, period = find_runs(rows, words)
    firsts = np.searchsorted(rows, np.arange(len(given)))
    got = [[] for _ in given]
    for s, n, q in zip(place.tolist(), length.tolist(), period.tolist(), strict=True):
        got[rows[s]].append((s - firsts[rows[s]], n, q))
    assert sum(map(len, got)) > 300
    for text, own in zip(given, got, strict=True):
        assert own == plain_runs(text), text


def test_long_run_needs_few_steps():
    place, length, period = find_runs(np.zeros(300_001, np.int64), np.append(np.tile(np.arange(3), 100_000), 9).astype(np.uint64))
    assert (place.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [3])


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(200)
    low, high, value = rng.integers(0, 100, 500), rng.integers(100, 201, 500), rng.integers(0, 230, 500)
    want = [min([v for v in values[a:b] if v >= x], default=200) for a, b, x in zip(low, high, value, strict=True)]
    assert Wavelet(values).successor(low, high, value).tolist() == want


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def expected(doc_id, text):
    words = split(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(kept))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted(expected(r.doc_id, r.text) for r in docs)
    assert sorted(map(tuple, op13_query(spark, sf_dir).collect())) == want
    assert sum(w[1] > 0 for w in want) > 20


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_odd_rows(spark, kind):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "la " * 50_000, "x"), (5, "é ü " * 30, "x"), (5, "é ü " * 30, "x"), (None, "a b " * 20, "x"), (7, "a b c", "x")]
    docs = spark.createDataFrame([(r[0] if kind == "bigint" or r[0] is None else str(r[0]), *r[1:]) for r in rows], f"doc_id {kind}, text string, runs string")
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=str)
    assert got == sorted([
        ("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 50_000, [(0, 50_000, 1)], "la"),
        *[("5", 30, [(0, 30, 1)], "é ü")] * 2, ("None", 40, [(0, 40, 2)], "a b"), ("7", 3, [], "a b c"),
    ], key=str)
    assert periodic_runs(docs.where("false")).count() == 0
