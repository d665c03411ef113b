import re
from collections import Counter

import numpy as np
import pytest

from urlgauge.llm.collocations import HatTrie, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000):
    f, total = {}, Counter()
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        found = []
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in cand.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside.get(p[i : i + size], 0), a)
        for p, a in cand.items():
            if inside.get(p, 0) >= a:
                continue
            score, _, l, r = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def sample():
    rng = np.random.default_rng(8)
    words = np.array(["New", "york", "the", "of", "a", "é", "x\x00y", "\U0001d7d8", "￮", *(f"w{i}" for i in range(12))])
    rows = [(str(rng.choice(["en", "de"])), "".join(rng.choice(words) + str(rng.choice([" ", " ", " ", "\t", ", ", "\n", "  "])) for _ in range(rng.integers(1, 90)))) for _ in range(120)]
    rows += [("en", "new york city of the world. " * 9)] * 5 + [(None, "A b a b a b a b"), (None, None), ("en", ""), ("fr", None), ("", "p q, p q; p q"), ("en", " .,;\n ")]
    return rows


@pytest.mark.parametrize("memory", [{}, {"held": 50, "burst": 4, "bits": 1 << 8}, {"held": 300, "burst": 2, "bits": 1 << 15}])
def test_equal_to_brute_force(spark, memory):
    rows = sample()
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id int, lang string, text string, score int").repartition(5)
    got = collocations(docs, least=3, **memory)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for n, t in got.dtypes if n not in ("lang", "phrase")} == {"bigint"}
    want = brute(rows, 3)
    assert len(want) > 100 and {w[0] for w in want} >= {"en", "de", "und", ""}
    assert sorted(map(tuple, got.collect())) == want


def test_large_products_are_exact(spark):
    # a * n * 1000 passes 64 bits in the arithmetic; the same rows by Python's numbers
    from pyspark.sql import functions as F

    numbers = [(4_000_000_000_000, 9_007_199_254_740_993, 4_000_000_000_001, 4_000_000_000_007)]
    df = spark.createDataFrame(numbers, "a bigint, n bigint, l bigint, r bigint")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    df = df.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), "below": exact("l") * exact("r")})
    a, n, l, r = numbers[0]
    assert df.select(F.expr("above div below")).first()[0] == 1000 * a * n // (l * r)


def test_top_and_no_rows(spark):
    docs = spark.createDataFrame([("en", "a b c a b " * 40)], "lang string, text string")
    assert [r.rank for r in collocations(docs, least=2, top=3).collect()] == [1, 2, 3]
    assert collocations(docs.where("false")).count() == 0 and collocations(docs, least=10_000).count() == 0


def test_trie_counts_and_spills_subtrees():
    rng = np.random.default_rng(2)
    trie, want, got = HatTrie(3, burst=5), Counter(), Counter()

    def take(runs):
        for phrases, counts in runs:
            got.update(dict(zip(map(tuple, phrases.tolist()), counts.tolist(), strict=True)))

    for _ in range(30):
        phrases, counts = np.unique(rng.integers(0, 6, (60, 3)), axis=0, return_counts=True)
        trie.add(phrases, counts)
        want.update(dict(zip(map(tuple, phrases.tolist()), counts.tolist(), strict=True)))
        if trie.size > 100:
            firsts = [path for path, *_ in trie.subtrees()]
            assert len(firsts) == 6 and all(len(p) == 1 for p in firsts)  # the root has burst
            take(trie.spill(50))
            assert 0 < trie.size <= 50
    take(trie.spill(-1))
    assert got == want and trie.size == 0
