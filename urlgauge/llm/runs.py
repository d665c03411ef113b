"""Periodic runs of words by internal pattern matching.

A run is a stretch of words that repeats itself with a period. Every run of period q holds a block of 2**k words,
2**k about q, at a place divisible by 2**k, and the same block again q words on. So for each dyadic block one asks
where it occurs next in the window that follows it: its occurrences are an interval of the suffix array, and a wavelet
matrix over the array gives the smallest place in the interval from a given one on (range successor). Occurrences that
overlap by half form arithmetic progressions, of which only the ends can be periods of longer runs. Each candidate is
then extended both ways by longest common extensions.

The words of a text are ranked by prefix doubling, which gives the classes of all blocks, the suffix array and the
extensions, exactly and without hashes of blocks. A text is looked at as a whole, in one task; many short ones together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T

LEAST = 24
#: Words of the smallest blocks; with LEAST >= 3 * BLOCK they find every period below 2 * BLOCK.
BLOCK = 8
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Ranks:
    """Ranks of all stretches of 2**k symbols, for each k up to the first where no two are equal."""

    def __init__(self, symbols: np.ndarray):
        self.levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        while len(symbols) and self.levels[-1].max() + 1 < len(symbols):
            self.levels.append(_doubled(self.levels[-1], 1 << (len(self.levels) - 1)))
        self.order = np.argsort(self.levels[-1])

    def interval(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 place in the suffix array of the suffixes that begin like those `at`."""
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.levels[level]))])
        return bounds[self.levels[level][at]], bounds[self.levels[level][at] + 1]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ok = np.flatnonzero((i < len(self.order)) & (j < len(self.order)))
            ok = ok[self.levels[level][i[ok]] == self.levels[level][j[ok]]]
            for x in (i, j, total):
                x[ok] += 1 << level
        return total

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            ok = np.flatnonzero((i >= step) & (j >= step))
            ok = ok[self.levels[level][i[ok] - step] == self.levels[level][j[ok] - step]]
            i[ok] -= step
            j[ok] -= step
            total[ok] += step
        return total


def _doubled(ranks: np.ndarray, step: int) -> np.ndarray:
    second = np.zeros(len(ranks), np.int64)
    second[: max(len(ranks) - step, 0)] = ranks[step:] + 1
    return np.unique(ranks.astype(np.int64) * (len(ranks) + 1) + second, return_inverse=True)[1].astype(np.int32)


class Wavelet:
    """A wavelet matrix of different numbers 0..n-1, as packed bits with counts for each 64 of them."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits, self.planes = len(values), max(int(len(values) - 1).bit_length(), 1), []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            packed = np.packbits(np.append(ones, np.zeros(-len(ones) % 64 + 64, bool)), bitorder="little").view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((packed, counts, len(ones) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def _ones(self, plane: int, upto: np.ndarray) -> np.ndarray:
        packed, counts, _ = self.planes[plane]
        word = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(packed[word] & mask)

    def _below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of places low..high-1 hold numbers below `value`."""
        total, low, high = np.zeros(len(low), np.int64), low.copy(), high.copy()
        for plane in range(self.bits):
            bit = (value >> (self.bits - 1 - plane)) & 1
            a, b = self._ones(plane, low), self._ones(plane, high)
            zeros = self.planes[plane][2]
            total += np.where(bit == 1, (high - b) - (low - a), 0)
            low, high = np.where(bit == 1, zeros + a, low - a), np.where(bit == 1, zeros + b, high - b)
        return total

    def successor(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest number of places low..high-1 that is `value` or more; n if there is none."""
        inside = value < self.n
        nth = np.where(inside, self._below(low, high, np.where(inside, value, 0)), high - low)
        found = nth < high - low
        low, high, nth, out = low.copy(), high.copy(), np.where(found, nth, 0), np.zeros(len(low), np.int64)
        for plane in range(self.bits):
            a, b = self._ones(plane, low), self._ones(plane, high)
            zeros, here = self.planes[plane][2], (high - b) - (low - a)
            one = nth >= here
            nth = np.where(one, nth - here, nth)
            out = (out << 1) | one
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return np.where(found, out, self.n)


def _candidates(ranks: Ranks, level: int, wavelet: Wavelet) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks of 2**level words and distances at which they may be repeated."""
    size = 1 << level
    at = np.arange(0, len(ranks.order), size)
    low, high = ranks.interval(level, at)
    again = high - low > 1
    at, low, high = at[again], low[again], high[again]
    cursor, places, distances = at + 1, [at[:0]], [at[:0]]

    def note(p, d):
        ok = (d > 0) & (d < 2 * size)
        places.append(p[ok])
        distances.append(d[ok])

    while len(at):
        here = wavelet.successor(low, high, cursor)
        on = here < np.minimum(at + 2 * size, wavelet.n)
        at, low, high, here = at[on], low[on], high[on], here[on]
        note(at, here - at)
        following = wavelet.successor(low, high, here + 1)
        cursor = here + 1
        chain = np.flatnonzero((following < wavelet.n) & (following - here <= size // 2))
        p, x = at[chain], here[chain]
        step = following[chain] - x
        own_end, end = p + step + ranks.ahead(p, p + step), x + step + ranks.ahead(x, x + step)
        note(p, end - own_end)
        note(p, x - ranks.back(x, x + step) - (p - ranks.back(p, p + step)))
        cursor[chain] = x + (end - size - x) // step * step + 1
    return np.concatenate(places), np.concatenate(distances)


def find_runs(rows: np.ndarray, words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts that follow each other: place of the first word, length, smallest period; by place and period.

    rows: the text of each word, rising; words: equal numbers for equal words. A run has at least `least` words and
    three periods, and no neighbouring word of its text goes on with the period.
    """
    if least < 3 * BLOCK:
        raise ValueError(f"runs have {3 * BLOCK} words or more")
    none = (np.zeros(0, np.int64),) * 3
    own = np.arange(len(rows))
    for level in range(-1, BLOCK.bit_length() - 1):  # texts without an equal pair of the smallest blocks have no run
        if level < 0:
            order = np.lexsort((words, rows))
            new = np.ones(len(order), bool)
            new[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
            ranks = np.empty(len(order), np.int32)
            ranks[order] = np.cumsum(new) - 1
        else:
            ranks = _doubled(ranks, 1 << level)
    if not len(own):
        return none
    again = np.bincount(ranks)[ranks] > 1
    own = own[np.isin(rows, np.unique(rows[again]))]
    if not len(own):
        return none
    # words of a text and a symbol of its own after it, so that nothing equal crosses texts
    text = np.unique(rows[own], return_inverse=True)[1]
    spot = np.arange(len(own)) + text
    symbols = np.empty(len(own) + text[-1] + 1, np.int64)
    ends = np.append(np.flatnonzero(np.diff(text)), len(own) - 1) + np.arange(text[-1] + 1) + 1
    order = np.lexsort((words[own], text))
    new = np.ones(len(order), bool)
    new[1:] = (words[own][order][1:] != words[own][order][:-1]) | (text[order][1:] != text[order][:-1])
    symbols[spot[order]] = np.cumsum(new) - 1
    symbols[ends] = len(own) + np.arange(len(ends))
    at = np.full(len(symbols), -1)
    at[spot] = own
    ranks = Ranks(symbols)
    wavelet, found = Wavelet(ranks.order), []
    for level in range(BLOCK.bit_length() - 1, len(ranks.levels) - 1):
        p, d = _candidates(ranks, level, wavelet)
        start, end = p - ranks.back(p, p + d), p + d + ranks.ahead(p, p + d)
        ok = end - start >= np.maximum(least, 3 * d)
        found.append(np.stack([start[ok], end[ok], d[ok]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # of one stretch the smallest period
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return at[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]


def _strongest(runs: list[dict]) -> dict | None:
    best = None
    for run in runs:  # by start, then period: a later one must be truly stronger
        if best is None or run["length"] * best["period"] > best["length"] * run["period"]:
            best = run
    return best


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), strongest and collapsed of each row of `docs`.

    docs: doc_id, text; other columns are not looked at. Words are what stands between ASCII white space, numbered from
    0; a null text has none. A run is a stretch of at least `least` words and three times its smallest period that no
    neighbouring word extends. strongest is the run with the greatest length/period (ties: smallest start, then
    period), null without runs. collapsed holds the words, joined by one space, without those that some run contains
    after its first period. Repeated rows each give a row; an empty table gives none. Long texts are looked at whole.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(1))
            for a, b in T.chunks(bounds):
                w = T.words(data, bounds[a : b + 1], T.SPACES, lower=False)
                start, length, period = find_runs(w.rows, w.hashes, least)
                row = w.rows[start]
                dropped = T.covered(start + period, start + length, len(w.rows))
                begin = start - w.firsts[row]
                edges = np.searchsorted(row, np.arange(b - a + 1))
                runs, kept = [], []
                for i in range(b - a):
                    x, y = w.firsts[i], w.firsts[i + 1]
                    some = slice(edges[i], edges[i + 1])
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in zip(begin[some].tolist(), length[some].tolist(), period[some].tolist(), strict=True)])
                    text = data[bounds[a + i] : bounds[a + i + 1]].tobytes().split()
                    kept.append(b" ".join(text[k] for k in np.flatnonzero(~dropped[x:y]).tolist()) if runs[-1] else b" ".join(text))
                out = [batch.column(0).slice(a, b - a), np.diff(w.firsts), pa.array(runs, _RUN_TYPE), pa.array(map(_strongest, runs), _RUN_TYPE.value_type), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.record_batch(out, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {_RUNS}, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string")


def with_planted_tails(text: Column, key: Column) -> Column:
    """The query's own test texts: of every tenth key's text, the words from some place on repeat with some period."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        spot = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, spot(i).cast("int"))), " ")

    # a list of one, so that the words are cut once
    changed = F.get(F.transform(F.array(words), planted), 0)
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), changed).otherwise(text)


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", with_planted_tails(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.*",
        F.floor(F.lit(1000) * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
