"""Repeated phrases by Aho-Corasick automata, one for each shard of recurring passages.

Passages that may recur are dealt over shards by their anchor. A shard confirms which windows of words recur in
its distinct segments, joins neighbouring ones to passages, compiles them into one automaton and streams all
segments of the documents that share its anchors through it, which locates every occurrence of every passage.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._repeats import GROUP, Unit, apply_removal, repeated_segments
from urlgauge.llm._tables import row_key

WINDOW = 35


def _as_symbols(contents: list[bytes]) -> list[str]:
    """Each text as a string with one character for each distinct word."""
    known: dict[bytes, str] = {}
    out = []
    for text in contents:
        own = []
        for word in text.split():
            symbol = known.get(word)
            if symbol is None:
                code = len(known) + 0x100
                symbol = known[word] = chr(code if code < 0xD800 else code + 0x800)
            own.append(symbol)
        out.append("".join(own))
    return out


def recurring_passages(texts: list[str], counts: np.ndarray, window: int) -> tuple[set[str], dict[str, int]]:
    """Confirmed passages: maximal runs of windows that occur at least twice; and where each window occurs first."""
    total: dict[str, int] = {}
    first: dict[str, int] = {}
    for nth, (text, count) in enumerate(zip(texts, counts.tolist(), strict=True)):
        for at in range(len(text) - window + 1):
            piece = text[at : at + window]
            total[piece] = total.get(piece, 0) + count
            first.setdefault(piece, nth)
    passages = set()
    for text in texts:
        start = None
        n = len(text) - window + 1
        for at in range(n + 1):
            if at < n and total[text[at : at + window]] > 1:
                start = at if start is None else start
            elif start is not None:
                passages.add(text[start : at - 1 + window])
                start = None
    return passages, first


def automaton(passages: set[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for passage in sorted(passages):
        built.add_word(passage, len(passage))
    built.make_automaton()
    return built


def repeats(contents: list[bytes], counts: np.ndarray, window: int, keep_first: bool) -> list[np.ndarray]:
    """For each text a flag for each window that recurs (keep_first: whose first occurrence is an earlier text)."""
    texts = _as_symbols(contents)
    passages, first = recurring_passages(texts, counts, window)
    flags = [np.zeros(len(t) - window + 1, bool) for t in texts]
    if not passages:
        return flags
    built = automaton(passages)
    for nth, (text, own) in enumerate(zip(texts, flags, strict=True)):
        for end, size in built.iter(text):
            own[end - size + 1 : end - window + 2] = True
        if keep_first:
            for at in np.flatnonzero(own).tolist():
                own[at] = first[text[at : at + window]] != nth
    return flags


def repeated_phrases(docs: DataFrame, window: int = WINDOW, keep: str = "first", group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and rest (the kept words, joined by one space) of each row of `docs`.

    docs: doc_id, text; other columns are not looked at. Words are what stands between ASCII white space, unchanged;
    a null text has none. A word goes if `window` consecutive words that also start elsewhere cover it: with
    keep="none" anywhere else, with keep="first" at an earlier place, by doc_id and position. Windows never cross
    texts and are judged on the input. Repeated rows are copies of each other: with keep="none" they go, with
    keep="first" equal rows (doc_id and text) are treated alike. An empty table gives no rows.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    unit = Unit(window, max(window * 2 // 7, 1), by_word=True)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("__row", row_key())
    found = repeated_segments(docs.withColumnRenamed("__row", "row"), unit, repeats, keep == "first", group)

    def make(batch, values, flags, firsts, words):
        gone, rest = [], []
        texts, bounds = T.flat(batch.column("text"))
        for row, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
            own = texts[bounds[row] : bounds[row + 1]].tobytes().split()
            gone.append(int(np.count_nonzero(flags[a:b])))
            rest.append(b" ".join(compress(own, (~flags[a:b]).tolist()) if gone[-1] else own))
        return [batch.column(0), np.diff(firsts), pa.array(gone, pa.int64()), pa.array(rest, pa.binary()).cast(pa.string())]

    kind = dict(docs.dtypes)["doc_id"]
    return apply_removal(docs, found, unit, make, f"doc_id {kind}, n_words bigint, n_removed bigint, rest string", ["doc_id", "n_words", "n_removed", "rest"])


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="none")
    return found.select("doc_id", "n_words", "n_removed", F.sha2("rest", 256).alias("kept_sha256"))
