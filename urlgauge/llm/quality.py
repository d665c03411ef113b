"""Quality of texts by a generalised additive model with pairwise interactions.

Boosting goes round the features in cycles; each step fits a shallow tree on one feature and adds its leaves to
that feature's look-up table. Then the pairs of features that explain most of what is left get tables of their
own. A text's score is the logistic of the sum of its bins' entries: every table can be read, and scoring is a
few vectorised look-ups and additions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._samples import held_out, label_sample

MODULUS = 4
#: Labelled rows of each class that the model is fitted on at most; everything else covers all rows.
ROWS_PER_CLASS = 4_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 300
RATE = 0.05
THRESHOLD = 0.7

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "point": b".,;:?'\"()-", "mark": b"!", "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "line": b"\n", "other": range(128, 256)}
FEATURES = (
    "log_bytes", "log_words", "word_bytes", *(f"share_{x}" for x in _CLASSES), "distinct_words", "word_again", "gram_again", "longest_word", "top_word", "line_words", "symbol_words",
)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x features of whole texts; an empty text has zeros."""
    w = T.words(data, bounds, T.SPACES)
    own, sizes, rows = data[bounds[0] : bounds[-1]], np.diff(bounds), len(bounds) - 1
    words = np.diff(w.firsts)
    per_byte, per_word = 1 / np.maximum(sizes, 1), 1 / np.maximum(words, 1)
    of = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(of * 256 + own, minlength=rows * 256).reshape(rows, 256)
    shares = [kinds[:, list(members)].sum(axis=1) * per_byte for members in _CLASSES.values()]
    by_word = lambda flags: np.bincount(w.rows[: len(flags)][flags], minlength=rows) * per_word
    same = lambda n: (w.hashes[n:] == w.hashes[:-n]) & (w.rows[n:] == w.rows[:-n]) if len(w.hashes) > n else np.zeros(0, bool)
    order = np.lexsort((w.hashes, w.rows))
    new = np.ones(len(order), bool)
    new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (w.rows[order][1:] != w.rows[order][:-1])
    heads = np.flatnonzero(new)
    repeats = np.diff(np.append(heads, len(order)))
    top = np.zeros(rows)
    np.maximum.at(top, w.rows[order][heads], repeats)
    length = w.ends - w.starts
    longest = np.zeros(rows)
    np.maximum.at(longest, w.rows, length)
    last = w.data[w.ends - 1] if len(length) else np.zeros(0, np.uint8)
    symbol = np.isin(last, np.frombuffer(_CLASSES["symbol"] + b"!", np.uint8))
    return np.stack(
        [np.log1p(sizes), np.log1p(words), np.bincount(w.rows, length, rows) * per_word, *shares, np.bincount(w.rows[order][heads], minlength=rows) * per_word, by_word(same(1)), np.minimum(by_word(same(2)) + by_word(same(3)), 2), np.log1p(longest), top * per_word, np.log1p(words / (kinds[:, 10] + 1)), by_word(symbol)],
        axis=1,
    ).astype(np.float64)


@dataclass
class AdditiveModel:
    """cuts: bin edges of each feature; tables: what each bin adds; pairs: (feature, feature) with a table each."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, i], side="right")]
        bins = {i: np.searchsorted(self.pair_cuts[i], x[:, i], side="right") for pair in self.pairs for i in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _sums(bins: np.ndarray, size: int, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(bins, grad, size), np.bincount(bins, hess, size)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 3.0) -> np.ndarray:
    """Leaf values over the bins of a shallow tree, by gradient and curvature of each bin."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
        gain[(left_h < least) | (right_h < least)] = -1
        cut = int(np.argmax(gain))
        if gain[cut] > g.sum() ** 2 / (h.sum() + 1):
            return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1, least), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, least)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def _table(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values over pairs of bins: the better first axis, then a split of each half by the other axis."""
    best, value = -1.0, None
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            part = np.concatenate([np.tile(_tree(x.sum(axis=0), y.sum(axis=0), 1), (len(x), 1)) for x, y in ((a[:cut], b[:cut]), (a[cut:], b[cut:]))])
            gain = float((part * a).sum())
            if gain > best:
                best, value = gain, part.T if turn else part
    return value if value is not None else np.zeros_like(g)


def fit_additive(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of per-feature tables, then of the tables of the strongest pairs."""
    weight = weight / weight.mean()
    rate = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    model = AdditiveModel(_cuts(x, BINS), float(np.log(rate / (1 - rate))), [], _cuts(x, PAIR_BINS))
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for i, own in enumerate(bins):
            step = RATE * _tree(*_sums(own, len(model.tables[i]), *slopes()))
            model.tables[i] += step
            total += step[own]
    small = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]
    both = lambda i, j, s: tuple(v.reshape(size[i], size[j]) for v in _sums(small[i] * size[j] + small[j], size[i] * size[j], *s))
    s = slopes()
    gains = sorted(((float((_table(*(m := both(i, j, s))) * m[0]).sum()), i, j) for i, j in combinations(range(len(bins)), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(rounds // 10):
        for k, (i, j) in enumerate(model.pairs):
            step = 2 * RATE * _table(*both(i, j, slopes()))
            model.pair_tables[k] += step
            total += step[small[i], small[j]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS_PER_CLASS, modulus: int = MODULUS) -> AdditiveModel | None:
    """A model of `label` (0/1) from rows that are not held out; None if there are none.

    rows: how many rows of each class the fit sees at most, chosen by a hash of doc_id; each is weighted by the
    rows it stands for.
    """
    chosen = label_sample(labels.select("doc_id", label).where(F.col(label).isin(0, 1)), label, rows, modulus).toDF("doc_id", "y", "weight")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(2))
            for a, b in T.chunks(bounds):
                x = features(data, bounds[a : b + 1])
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "weight", "x"])

    # at most 2 * `rows` short rows: a bounded broadcast, and a bounded sample of features comes back
    sample = texts.join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("double"), "weight", "text").mapInArrow(run, "y double, weight double, x array<double>").toArrow()
    if not sample.num_rows:
        return None
    x = np.array(sample.column("x").to_pylist())
    y, weight = np.asarray(sample.column("y")), np.asarray(sample.column("weight"))
    order = np.lexsort((*x.T, weight, y))  # the same for any order of arrival
    return fit_additive(x[order], y[order], weight[order])


def score_quality(docs: DataFrame, model: AdditiveModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of each row of `docs`; other columns are not looked at.

    The score is from 0 to 1, of the whole text; null counts as empty, which the model scores like any text. Without
    a model every score is 0.5. Repeated rows each give a row; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of at most BINS entries

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(1))
            parts = [sent.value.score(features(data, bounds[a : b + 1])) if sent.value else np.full(b - a, 0.5) for a, b in T.chunks(bounds)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([batch.column(0), score, (score >= threshold).astype(np.int32)], names=["doc_id", "score", "predicted"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(MODULUS).alias("held_out"), "score", "predicted")
