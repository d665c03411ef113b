"""Language of texts: averaged hashed subword embeddings and a linear softmax, trained by gradient descent in NumPy.

A text is the average of the embeddings of its letter n-grams; a softmax over a linear map of the average gives
the languages. Training keeps embeddings and map apart; scoring uses their product, one small table of each
n-gram's logits, so a text costs one look-up for each n-gram. Confidence is calibrated by a temperature on rows
left out of the descent.

That probability only weighs the learned languages against each other, so it does not tell a text of none of them.
Rejection has a measure of its own: how usual the text's n-grams are in the learned language that knows each of
them best. Its cut is calibrated on texts of a language that the measure has not seen, each language in turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._samples import held_out, label_sample

BUCKET_BITS = 15
GRAMS = (3, 4)
DIMENSIONS = 16
#: Rows of each language that the descent sees at most; everything else covers all rows.
ROWS_PER_LANGUAGE = 800
#: The share of texts in learned languages that the cut may reject; and where there is no second language to leave
#: out, how far from them to letter noise the cut lies.
LOST, TO_NOISE = 0.005, 1 / 3
MODULUS = 4
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each letter n-gram of the rows, and its row. All but letters counts as one blank."""
    own = _LETTERS[data[bounds[0] : bounds[-1]]]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out, of = [], []
    for n in GRAMS:
        if len(own) < n:
            continue
        size = len(own) - n + 1
        code = own[:size].astype(np.uint32)
        for k in range(1, n):
            code |= own[k : k + size].astype(np.uint32) << np.uint32(8 * k)
        ok = (own[1 : size + 1] != 32) & (rows[:size] == rows[n - 1 :])
        out.append(((code[ok] * np.uint32(2654435761) + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
        of.append(rows[:size][ok])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    usual: np.ndarray
    cut: float

    def probabilities(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows x languages."""
        return self.measured(data, bounds)[0]

    def measured(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, rows x languages, and how usual each row's n-grams are on average; 0 without any."""
        rows = len(bounds) - 1
        found, of = buckets(data, bounds)
        counts = np.bincount(of, minlength=rows)
        sums = np.stack([np.bincount(of, self.table[:, i][found], rows) for i in range(len(self.languages))], axis=1)
        usual = np.bincount(of, self.usual[found], rows) / np.maximum(counts, 1)
        return softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature), usual


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def familiarity(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, train: np.ndarray, test: np.ndarray, kinds: int) -> tuple[np.ndarray, float]:
    """How usual each bucket is, log2 of its share in the language that has it most, and the least mean of a text.

    Shares are smoothed by what `test` has in buckets that `train` lacks, and count from the language's own mean, so
    that languages compare. A language's texts are measured without it, too, as texts of an unknown language are:
    the cut parts them and letter noise (all buckets alike) from texts measured with all languages, and loses at most
    the share LOST of these.
    """
    logs = np.zeros((kinds, 1 << BUCKET_BITS))
    for kind in range(kinds):
        own = [i for i in train if labels[i] == kind]
        tried = [i for i in test if labels[i] == kind] or own
        for i in own:
            logs[kind][ids[i]] += shares[i] / len(own)
        unseen = np.mean([shares[i][logs[kind][ids[i]] == 0].sum() for i in tried]) if tried else 1.0
        part = min(max(unseen, 0.01), 1.0)
        logs[kind] = np.log2((1 - part) * logs[kind] + part / (1 << BUCKET_BITS))
        logs[kind] -= np.mean([logs[kind][ids[i]] @ shares[i] for i in tried]) if tried else 0.0
    usual, best = logs.max(axis=0), logs.argmax(axis=0)
    if not len(test):
        return usual, 0.0
    known = np.array([usual[ids[i]] @ shares[i] for i in test])
    most = np.quantile(known, LOST)
    if kinds < 2:
        return usual, float(min(most, np.median(known) + TO_NOISE * (usual.mean() - np.median(known))))
    second = np.partition(logs, -2, axis=0)[-2]
    left_out = [usual.mean()]
    for i in np.concatenate([train, test]):
        left_out.append(np.where(best[ids[i]] == labels[i], second[ids[i]], usual[ids[i]]) @ shares[i])
    return usual, float(min(most, _parting(known, np.array(left_out))))


def _parting(known: np.ndarray, other: np.ndarray) -> float:
    """The cut with the least sum of the shares of `known` below it and of `other` from it on; the middle of its gap."""
    known, other = np.sort(known), np.sort(other)
    at = np.unique(np.concatenate([known, other]))
    wrong = np.searchsorted(known, at) / len(known) + 1 - np.searchsorted(other, at) / len(other)
    best = int(np.argmin(wrong))
    return float((at[max(best - 1, 0)] + at[best]) / 2)


def _histograms(batches):
    """(lang, weight, bucket ids, shares) of each text; at most as many entries as there are buckets."""
    for batch in batches:
        data, bounds = T.flat(batch.column(1))
        for a, b in T.chunks(bounds):
            found, of = buckets(data, bounds[a : b + 1])
            key, count = np.unique((of.astype(np.int64) << BUCKET_BITS) | found, return_counts=True)
            row = key >> BUCKET_BITS
            share = (count / np.bincount(of, minlength=b - a)[row]).astype(np.float32)
            offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array((key & ((1 << BUCKET_BITS) - 1)).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(share))],
                names=["lang", "ids", "shares"],
            )


def descend(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, languages: list[str], epochs: int = 12, steps: int = 600, rate: float = 40.0, batch: int = 32) -> LanguageModel:
    """Stochastic gradient descent over the rows; every fifth row is left out for the temperature and the cut.

    Few rows are gone over more often, so that there are at least `steps` steps.
    """
    rng = np.random.default_rng(7)
    kinds = len(languages)
    vectors = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, kinds), np.float32), np.zeros(kinds, np.float32)
    full = np.array([i for i, x in enumerate(ids) if len(x)], np.int64)
    test, train = (full[::5], full[np.arange(len(full)) % 5 != 0]) if len(full) > 20 else (full, full)
    scale = np.bincount(labels[train], minlength=kinds)
    scale = (len(train) / np.maximum(scale, 1) / max(kinds, 1)).astype(np.float32)
    epochs = max(epochs, -(-steps * batch // max(len(train), batch)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(train), max(len(train) // batch, 1)):
            if not len(at):
                continue
            one = np.concatenate([ids[i] for i in at])
            share = np.concatenate([shares[i] for i in at])[:, None]
            sizes = np.array([len(ids[i]) for i in at])
            mean = np.add.reduceat(vectors[one] * share, np.cumsum(sizes) - sizes)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(at)), labels[at]] -= 1
            error *= scale[labels[at]][:, None] / len(at)
            back = error @ weights.T
            weights -= step / 10 * mean.T @ error
            bias -= step / 400 * error.sum(axis=0)
            np.subtract.at(vectors, one, step * share * np.repeat(back, sizes, axis=0))
    table = vectors @ weights
    logits = np.array([table[ids[i]].T @ shares[i] + bias for i in test]).reshape(-1, kinds)
    choices = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(test)), labels[test]], 1e-12)).mean() if len(test) else 0 for t in choices]
    usual, cut = familiarity(ids, shares, labels, train, test, kinds)
    return LanguageModel(languages, table.astype(np.float32), bias, float(choices[int(np.argmin(loss))]), usual.astype(np.float32), cut)


def fit_language(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, modulus: int = MODULUS) -> LanguageModel | None:
    """A model from text and lang of rows that are not held out; None without any labelled text.

    rows: how many rows of each language the descent sees at most, chosen by a hash of doc_id.
    """
    chosen = label_sample(docs.where("text is not null"), "lang", rows, modulus)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # at most `rows` short rows for each language: a bounded broadcast
    sample = texts.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(_histograms, "lang string, ids array<int>, shares array<float>").toArrow()
    langs = sample.column("lang").to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return None
    ids = [np.asarray(x.values) for x in sample.column("ids")]
    shares = [np.asarray(x.values) for x in sample.column("shares")]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], len(ids[i]), ids[i].tobytes(), shares[i].tobytes()))
    order = np.random.default_rng(1).permutation(order)  # the same for any order of arrival
    labels = np.array([languages.index(langs[i]) for i in order])
    return descend([ids[i] for i in order], [shares[i] for i in order], labels, languages)


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1, bool)
    own = data[bounds[0] : bounds[-1]]
    kinds = _LETTERS[own]
    of = np.searchsorted(bounds[1:] - bounds[0], np.flatnonzero((kinds != 32) & (own < 128)), side="right")
    out[of] = True
    for row in np.flatnonzero(~out).tolist():
        text = data[bounds[row] : bounds[row + 1]]
        out[row] = bool((text >= 128).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "ignore"))
    return out


def _predicted(model, batch_column, cut: float | None):
    """Languages, probabilities and whether there is a letter and a known language, of one text column."""
    data, bounds = T.flat(batch_column)
    langs, scores, accepted = [], [], []
    for a, b in T.chunks(bounds):
        has = _has_letter(data, bounds[a : b + 1])
        if model is None:
            best, score, known = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a, bool)
        else:
            p, usual = model.measured(data, bounds[a : b + 1])
            best, score, known = p.argmax(axis=1), p.max(axis=1), usual >= (model.cut if cut is None else cut)
        langs += [model.languages[i] if h and model else UNKNOWN for i, h in zip(best.tolist(), has.tolist(), strict=True)]
        scores.append(np.where(has, score, 0.0))
        accepted.append(has & known)
    none = np.zeros(0)
    return langs, np.concatenate(scores or [none]), np.concatenate(accepted or [none.astype(bool)])


def predict_language(docs: DataFrame, model: LanguageModel | None, cut: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score and accepted of each row of `docs`; other columns are not looked at.

    lang_pred is one of the model's languages, or `und` (score 0) where the text is null or has no letter, or
    there is no model. score is the calibrated probability among the learned languages; accepted tells whether the
    text is in any of them: its n-grams are on average as usual as `cut` asks (None: as calibrated by the fit). A
    text of letters too short for an n-gram has nothing against it. Repeated rows each give a row; an empty table
    gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: buckets x languages

    def run(batches):
        for batch in batches:
            langs, scores, accepted = _predicted(sent.value, batch.column(1), cut)
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), scores, accepted], names=["doc_id", "lang_pred", "score", "accepted"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(T.giving_back(run), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean")


def known_language(docs: DataFrame, model: LanguageModel | None, cut: float | None = None) -> DataFrame:
    """Rows of `docs`, all columns, whose language is recognised; the others are rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_predicted(sent.value, batch.column("text"), cut)[2]))

    return docs.mapInArrow(T.giving_back(run), docs.schema)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_language(docs, fit_language(docs))
    return found.select("doc_id", held_out(MODULUS).alias("held_out"), "lang_pred", "score", "accepted")
