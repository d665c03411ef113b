import hashlib
import re

import pytest

from urlgauge.llm.decontaminate import clean_documents, contamination, digest

SF = "/root/testdata/sf0.001"


def norm(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = norm(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = norm(text)
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= found
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


DOCS = [
    (1, "a b c d e f g h i j k l"), (2, "x a b c d e f g h i j y"), (3, None), (4, ""), (5, "short one"), (6, "Say: Short, ONE! é"),
    (7, "a b c d e f g h i"), (7, "a b c d e f g h i"), (None, "a b c d e f g h i j k"), (8, "..."), (9, "z " * 5000 + "a b c d e f g h i j"),
    (10, "q q q q q q q q q q q q q q"),
]
ITEMS = [(1, "A-B-C d e f g h i j k"), (2, "short one"), (3, None), (4, "!"), (None, "a b c d e f g h i j"), (10, "q q q q q q q q q q q"), (2, "short one"), (11, "é")]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_small(spark, limit):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, n_words int, spans string")
    items = spark.createDataFrame([(*d, 1) for d in ITEMS], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in digest(contamination(docs, items, broadcast_bytes=limit)).collect()]
    assert sorted(got, key=str) == brute(DOCS, ITEMS)
    kept = clean_documents(docs, items, broadcast_bytes=limit)
    assert kept.columns == docs.columns
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in DOCS if d not in bad), key=str)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_empty(spark, limit):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, items, broadcast_bytes=limit).count() == 0
    one = spark.createDataFrame([(1, "a b")], docs.schema)
    assert digest(contamination(one, items, broadcast_bytes=limit - 1)).first()[:4] == (1, 2, 0, 0)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_tables(spark, limit):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = [tuple(r) for r in digest(contamination(docs, items, broadcast_bytes=limit)).collect()]
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert sorted(got, key=str) == want and any(r[5] for r in want)
