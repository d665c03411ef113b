"""Repeated passages of bytes by suffix arrays and longest-previous-factor arrays.

Within a group of segments that can share a passage, the suffixes that can start one are sorted (a suffix array
over window starts). Each suffix's previous and next smaller text positions in that order give its longest
earlier match, the longest previous factor; where it reaches the window, the later copy is removed and the first
one stays. With keep="none" matches in both directions count, so every copy goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._repeats import GROUP, Unit, apply_removal, repeated_segments
from urlgauge.llm._tables import row_key

WINDOW = 200


def suffix_array(data: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` by their first `limit` bytes (equal ones by start), and the matching bytes of neighbours."""
    views = np.lib.stride_tricks.sliding_window_view(data, limit)[starts]
    # equal suffixes have equal hashes: only one of each needs to be compared
    _, one, which = np.unique(T.Hasher(data)(starts, starts + limit), return_index=True, return_inverse=True)
    rank = np.empty(len(one), np.int64)
    kept = np.ascontiguousarray(views[one])
    rank[np.argsort(kept.view(f"S{limit}").ravel())] = np.arange(len(one))
    order = np.argsort(rank[which], kind="stable")
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        lcp[1:] = np.where(which[order][1:] == which[order][:-1], limit, 0)
        apart = np.flatnonzero(lcp[1:] == 0) + 1
        lcp[apart] = np.argmax(views[order[apart]] != views[order[apart - 1]], axis=1)
    return order, lcp


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray, least: int = 0) -> np.ndarray:
    """For each suffix the longest match that starts at an earlier position (exact where it is `least` or more).

    order: positions in suffix order; lcp: match of each with its neighbour above. The nearest smaller position on
    either side is found by pointer jumping, with the minimum match on the way.
    """
    best = np.zeros(len(order), np.int64)
    for side in (1, -1):
        pos = order[::side]
        low = lcp.copy() if side == 1 else np.concatenate([[0], lcp[:0:-1]])
        prev = np.arange(len(pos)) - 1
        active = np.flatnonzero(prev >= 0)
        active = active[(pos[prev[active]] > pos[active]) & (low[active] >= least)]
        while len(active):
            p = prev[active]
            low[active], prev[active] = np.minimum(low[active], low[p]), prev[p]
            active = active[(prev[active] >= 0) & (low[active] >= max(least, 1))]
            active = active[pos[prev[active]] > pos[active]]
        low[prev < 0] = 0
        low[(prev >= 0) & (pos[np.maximum(prev, 0)] > pos)] = 0  # given up below `least`
        best[pos] = np.maximum(best[pos], low)
    return best


def repeats(contents: list[bytes], counts: np.ndarray, window: int, keep_first: bool) -> list[np.ndarray]:
    """For each text, in order, a flag for each window that repeats (keep_first: that occurs earlier)."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(x) for x in contents])
    firsts = np.cumsum(sizes) - sizes
    n = sizes - window + 1
    owner = np.repeat(np.arange(len(n)), n)
    starts = np.arange(n.sum()) + (firsts - np.cumsum(n) + n)[owner]
    order, lcp = suffix_array(data, starts, window)
    flags = longest_previous_factors(order, lcp, window) >= window
    if not keep_first:
        back = len(order) - 1
        flags |= longest_previous_factors(back - order, lcp, window)[::-1] >= window
        flags |= counts[owner] > 1
    return np.split(flags, np.cumsum(n)[:-1])


def _unit(window: int) -> Unit:
    return Unit(window, max(window // 4, 1), by_word=False)


def repeated_passages(docs: DataFrame, window: int = WINDOW, keep: str = "first", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and rest (binary) of each row of `docs`.

    docs: doc_id, text; other columns are not looked at. Texts are UTF-8 bytes, whole, null as empty; no match
    crosses a text. A byte goes if a `window`-byte string that also starts elsewhere covers it: with keep="none"
    anywhere else, with keep="first" at an earlier place, by doc_id and position. Matches may overlap and are
    judged on the input. Repeated rows are copies of each other: with keep="none" they go, with keep="first" equal
    rows (doc_id and text) are treated alike. An empty table gives no rows.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    unit = _unit(window)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("__row", row_key())
    found = repeated_segments(docs.withColumnRenamed("__row", "row"), unit, repeats, keep == "first", group)

    def make(batch, values, flags, firsts, _):
        total = np.diff(firsts)
        gone, spans, rest = [], [], []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            own = flags[a:b]
            gone.append(int(np.count_nonzero(own)))
            spans.append(len(T.run_bounds(own)[0]) if gone[-1] else 0)
            rest.append(values[a:b][~own].tobytes() if gone[-1] else values[a:b].tobytes())
        return [batch.column(0), total, pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(rest, pa.binary())]

    kind = dict(docs.dtypes)["doc_id"]
    return apply_removal(docs, found, unit, make, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, rest binary", ["doc_id", "n_bytes", "n_removed", "n_spans", "rest"])


def without_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with all columns, later copies of passages cut from `text` (and `n_chars` counted anew if there).

    A character that is cut in the middle goes whole. Null texts stay null.
    """
    unit = _unit(window)
    keyed = docs.withColumn("__row", row_key())
    found = repeated_segments(keyed.select("doc_id", F.col("__row").alias("row"), "text"), unit, repeats, keep_first=True)
    names = docs.columns

    def make(batch, values, flags, firsts, _):
        texts = []
        for own, a, b in zip(batch.column("text").to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            cut = own is not None and flags[a:b].any()
            texts.append(values[a:b][~flags[a:b]].tobytes().decode("utf-8", "ignore") if cut else own)
        columns = {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            old = batch.column("n_chars")
            columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
        return [columns.get(n, batch.column(n)) for n in names]

    return apply_removal(keyed, found, unit, make, docs.schema, names)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"))
