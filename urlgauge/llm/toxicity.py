"""Toxicity of texts by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of two units (words, or letters spelled one by one) sums over all subsequences of ORDER characters that they
share, gaps allowed, each weighted by DECAY to the power of the stretch it takes in either one (Lodhi et al. 2002), and
is normalised by both units' kernels with themselves. So an insult keeps most of its likeness when characters are
inserted, and an ending or a stem is enough for some of it.

A few landmark units span the space (Nyström): a unit becomes its kernels with them, whitened, and a linear machine
with squared hinge loss is fitted there. A sentence is as toxic as its most toxic unit, a text as its most toxic
sentence. Labels are known for texts only, so the first positives are units that toxic texts have far more often than
clean ones (copies count once); then the fit goes in rounds: each sentence of a clean text gives its highest unit as a
negative, and units of toxic texts that the machine finds toxic join the positives, until these stay the same.

The kernel is a dot product of weighted subsequences, so all landmarks with their weights add up to one table over
ORDER characters, and a unit's margin is a sum of look-ups in it: the same value, without a kernel per landmark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm._samples import label_sample, remainder

MODULUS = 5
#: The remainder of rows that no model learns from.
HELD_OUT = 0
#: Labelled texts of each class that the machine is fitted on at most; everything else covers all rows.
ROWS_PER_CLASS = 2_000
LANDMARKS = 320
#: Nats of evidence that make a word of toxic texts a positive of the first round.
EVIDENCE = 9.0
#: Characters of the subsequences, and what each character of their stretch weighs.
ORDER, DECAY = 3, 0.5
#: Characters of a unit, its two edges included; longer words are cut into overlapping pieces.
LONGEST = 16
ROUNDS = 4
#: Weight of the squared norm against the mean loss.
PENALTY = 1e-5
#: Negatives of a round: the highest units of clean sentences, and as many others.
NEGATIVES = 2_500
THRESHOLD = 0.5
_EDGE = "\x02"
_SPELLED = re.compile(r"(?<!\w)\w(?:[\W_]{1,3}\w(?!\w)){2,}")
_INNER = re.compile(r"[\W_]+")
_SENTENCES = re.compile(r"[.!?\n]+\s")


def units_of(token: str) -> list[str]:
    """The units of a word without white space: its letters and digits together, and each longer part of them."""
    parts = [p for p in _INNER.split(token) if p]
    whole = "".join(parts)
    found = [whole] if whole else []
    if len(parts) > 1:
        found += [p for p in parts if len(p) > 3]
    room = LONGEST - 2
    out = []
    for unit in found:
        if len(unit) <= room:
            out.append(f"{_EDGE}{unit}{_EDGE}")
        else:
            cut = [unit[i : i + room] for i in range(0, len(unit) - room + room // 2, room // 2)]
            out += [f"{_EDGE}{p}" if i == 0 else p for i, p in enumerate(cut)]
    return out


def tokens_of(text: str) -> set[str]:
    """Distinct words of a text in lower case, and what is spelled letter by letter."""
    text = text.lower()
    found = set(text.split())
    found.update("".join(m.split()) for m in _SPELLED.findall(text))
    return found


def _codes(units: list[str], size: int) -> np.ndarray:
    """Units x characters as numbers, 0 where a unit is shorter."""
    return np.array(units, f"<U{size}").view(np.uint32).reshape(len(units), size)


def self_kernels(codes: np.ndarray, decay: float = DECAY, order: int = ORDER) -> np.ndarray:
    """The subsequence kernel of each unit with itself, by dynamic programming over both copies."""
    n, size = codes.shape
    tail = np.triu(decay ** (np.arange(size)[None] - np.arange(size)[:, None]).clip(0))
    before = [np.ones((n, size + 1)), *(np.zeros((n, size + 1)) for _ in range(order - 1))]
    total = np.zeros(n)
    for at in range(size):
        same = (codes[:, at, None] == codes) & (codes[:, at, None] > 0)
        steps = [decay**2 * same * part[:, :-1] for part in before]
        total += steps[-1].sum(axis=1)
        for i in range(1, order):
            before[i] *= decay
            before[i][:, 1:] += steps[i - 1] @ tail
    return total


def _subsequences(codes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all subsequences of each unit (0: not of the landmarks' letters), and the weight of each spot."""
    size, base = codes.shape[1], len(letters) + 1
    own = np.searchsorted(letters, codes).clip(0, len(letters) - 1)
    own = np.where(letters[own] == codes, own + 1, 0).astype(np.int32)
    spots = np.array(list(combinations(range(size), ORDER)))
    place, known = np.zeros((len(codes), len(spots)), np.int32), np.ones((len(codes), len(spots)), bool)
    for column in spots.T:
        place = place * base + own[:, column]
        known &= own[:, column] > 0
    return np.where(known, place, 0), DECAY ** (spots[:, -1] - spots[:, 0] + 1)


def _by_size(units: list[str]):
    """(places, units) in groups of like length, some thousand at a time."""
    sizes = np.array([len(u) for u in units])
    for low, high in ((0, 8), (8, 12), (12, LONGEST)):
        some = np.flatnonzero((sizes > low) & (sizes <= high))
        for at in range(0, len(some), 2_000):
            part = some[at : at + 2_000]
            yield part, _codes([units[i] for i in part.tolist()], max(high, ORDER))


@dataclass
class ToxicModel:
    """letters: of the landmarks; table: what each subsequence adds; offset, slope and middle: margin and calibration."""

    landmarks: list[str]
    weights: np.ndarray
    letters: np.ndarray
    table: np.ndarray
    offset: float
    slope: float = 1.0
    middle: float = 0.0

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units))
        for part, codes in _by_size(units):
            place, weight = _subsequences(codes, self.letters)
            own = self_kernels(codes)
            out[part] = np.where(own > 0, (self.table[place] @ weight) / np.sqrt(np.maximum(own, 1e-12)), 0)
        return out + self.offset

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins - self.middle), -30, 30)))


def landmark_kernels(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Units x landmarks: normalised kernels."""
    codes = _codes(landmarks, LONGEST)
    letters = np.unique(codes)
    letters = letters[letters > 0]
    spots, weight = _subsequences(codes, letters)
    heavy = weight / np.sqrt(self_kernels(codes))[:, None]
    out = np.zeros((len(units), len(landmarks)))
    for first in range(0, len(landmarks), 64):  # a table for some landmarks at a time
        some = slice(first, first + 64)
        table = np.zeros(((len(letters) + 1) ** ORDER, len(spots[some])), np.float32)
        np.add.at(table, (spots[some], np.arange(table.shape[1])[:, None]), heavy[some])
        table[0] = 0
        for part, own_codes in _by_size(units):
            place, weight = _subsequences(own_codes, letters)
            weight = weight.astype(np.float32)
            for i, own in zip(part.tolist(), place, strict=True):
                known = np.flatnonzero(own)
                out[i, some] = weight[known] @ table[own[known]]
            out[part, some] /= np.sqrt(np.maximum(self_kernels(own_codes), 1e-12))[:, None]
    return out


def _collapsed(landmarks: list[str], weights: np.ndarray, offset: float) -> ToxicModel:
    codes = _codes(landmarks, LONGEST)
    letters = np.unique(codes)
    letters = letters[letters > 0]
    place, weight = _subsequences(codes, letters)
    table = np.zeros((len(letters) + 1) ** ORDER)
    np.add.at(table, place, weights[:, None] * weight / np.sqrt(np.maximum(self_kernels(codes), 1e-12))[:, None])
    table[0] = 0
    return ToxicModel(landmarks, weights, letters, table, offset)


def _pivots(kernels: np.ndarray, count: int) -> np.ndarray:
    """Landmarks among candidates by pivoted Cholesky: each time the one that the others explain least."""
    left, rows, chosen = np.ones(len(kernels)), np.zeros((0, len(kernels))), []
    while len(chosen) < min(count, len(kernels)):
        at = int(np.argmax(left))
        if left[at] < 1e-3:
            break
        row = (kernels[at] - rows[:, at] @ rows) / np.sqrt(left[at])
        rows = np.vstack([rows, row])
        left = left - row**2
        left[[*chosen, at]] = 0
        chosen.append(at)
    return np.array(chosen)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps over its support."""
    full = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    weight = weight / np.where(y > 0, weight[y > 0].sum(), weight[y <= 0].sum())
    ridge = penalty * np.eye(full.shape[1])
    ridge[-1, -1] = 1e-8
    w, active = np.zeros(full.shape[1]), None
    for _ in range(40):
        now = sign * (full @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = full[active] * weight[active, None]
        w = np.linalg.solve(a.T @ full[active] + ridge, a.T @ sign[active])
    return w[:-1], float(w[-1])


def _calibrated(model: ToxicModel, margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> ToxicModel:
    """Slope and middle of the probability, by Newton steps on the texts' margins, with softened targets (Platt)."""
    target = np.where(y > 0, 1 - 1 / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    coefficients = np.array([2.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        coefficients = coefficients + np.clip(np.linalg.solve(hessian, x.T @ (weight * (target - p))), -2, 2)
    model.slope = max(float(coefficients[0]), 0.1)
    model.middle = -float(coefficients[1]) / model.slope
    return model


def _evidence(toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """How unlikely it is (in nats) that units of so many toxic and clean texts fall on toxic ones by chance."""
    share = texts[0] / sum(texts)
    total, seen = toxic + clean, toxic / np.maximum(toxic + clean, 1)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    gain = total * (seen * (log(seen) - log(share)) + (1 - seen) * (log(1 - seen) - log(1 - share)))
    return np.where(seen > share, gain, 0)


def _one_of_copies(bags: list[list[list[str]]]) -> np.ndarray:
    """Flags of the first of texts with the same three smallest hashes of units: copies say nothing new about a word."""
    seen, out = set(), np.zeros(len(bags), bool)
    for i, bag in enumerate(bags):
        key = tuple(sorted(map(hash_of, {u for s in bag for u in s}))[:3])
        out[i] = key not in seen
        seen.add(key)
    return out


def fit_units(bags: list[list[list[str]]], y: np.ndarray, weight: np.ndarray, landmarks: int = LANDMARKS) -> ToxicModel | None:
    """A machine from labelled texts, each a list of sentences, each a list of units; None without both classes."""
    units = sorted({u for bag in bags for sentence in bag for u in sentence})
    if not units or not (y > 0).any() or not (y <= 0).any():
        return None
    number = {u: i for i, u in enumerate(units)}
    flat = [(i, s, number[u]) for i, bag in enumerate(bags) for s, sentence in enumerate(bag) for u in set(sentence)]
    bag, sentence, unit = (np.array(x) for x in zip(*flat, strict=True))
    _, own = np.unique(bag * (1 + sentence.max()) + sentence, return_inverse=True)
    toxic, single = y[bag] > 0, _one_of_copies(bags)
    pairs = np.unique(bag * len(units) + unit)
    text, member = pairs // len(units), pairs % len(units)
    often = [np.bincount(member[single[text] & ((y[text] > 0) == kind)], minlength=len(units)) for kind in (True, False)]
    sizes = (int(np.sum(single & (y > 0))), int(np.sum(single & (y <= 0))))
    evidence = _evidence(*often, sizes)
    clean = np.unique(unit[~toxic])
    # how many texts those of a class stand for: a word that is toxic one time in two is no positive
    stands = [float(weight[y > 0].mean()), float(weight[y <= 0].mean())]
    positive = np.flatnonzero((evidence > EVIDENCE) & (often[0] * stands[0] > 4 * often[1] * stands[1]))
    if not len(positive):  # few texts: the best word of each toxic one
        positive = np.setdiff1d(_highest(bag[toxic], unit[toxic], evidence), clean)
    spread = np.array(sorted(clean.tolist(), key=lambda i: hash_of(units[i])), np.int64)[:NEGATIVES]
    near = {units[i][j : j + 4] for i in positive.tolist() for j in range(len(units[i]) - 3)}
    margin = np.array([sum(u[j : j + 4] in near for j in range(len(u) - 3)) / len(u) for u in units])
    model, seen = None, None
    for _ in range(ROUNDS):
        if not len(positive) or np.array_equal(seen, positive):
            break
        seen = positive
        negative = np.setdiff1d(_highest(own[~toxic], unit[~toxic], margin), positive)
        negative = negative[np.argsort(-margin[negative], kind="stable")][:NEGATIVES]
        pool = [*positive[np.argsort(-often[0][positive], kind="stable")][: 2 * landmarks], *negative[:landmarks]]
        negative = np.union1d(negative, np.setdiff1d(spread, positive))
        texts = [units[i] for i in (*positive, *negative)] + [_with_insert(units[i]) for i in positive.tolist()]
        # a unit counts by the toxic texts it is in, so that a stray one weighs little
        heavy = np.sqrt(often[0][positive] + 1)
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(negative)), np.ones(len(positive))])
        each = np.concatenate([heavy, np.sqrt(often[1][negative] + 1), heavy / 4])
        pool = [units[i] for i in pool]
        chosen = [pool[i] for i in _pivots(landmark_kernels(pool, pool), landmarks)]
        between = landmark_kernels(chosen, chosen)
        values, vectors = np.linalg.eigh((between + between.T) / 2)
        whiten = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
        w, offset = _machine(landmark_kernels(texts, chosen) @ whiten, target, each)
        model = _collapsed(chosen, whiten @ w, offset)
        margin = model.margins(units)
        positive = np.union1d(positive, np.flatnonzero((margin > 0.5) & (often[0] > 1) & (often[1] == 0)))
    if model is None:
        return None
    top = np.full(len(bags), margin.min())
    np.maximum.at(top, bag, margin[unit])
    return _calibrated(model, top, y, weight)


def hash_of(text: str) -> int:
    """A number that is the same on every machine."""
    out = 0
    for c in text:
        out = (out * 1_000_003 + ord(c)) & 0xFFFFFFFFFFFF
    return out * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def _highest(group: np.ndarray, unit: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The unit of the highest margin in each group."""
    order = np.lexsort((unit, -margin[unit], group))
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    return np.unique(unit[order][first])


def _with_insert(unit: str) -> str:
    """The unit with one more letter somewhere inside, both by its hash."""
    h = hash_of(unit)
    at = 2 + h % max(len(unit) - 3, 1)
    return (unit[:at] + chr(97 + (h >> 20) % 26) + unit[at:])[:LONGEST]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS_PER_CLASS, modulus: int = MODULUS) -> ToxicModel | None:
    """A machine of `label` (0/1) from rows that are not held out; None without rows of both classes.

    rows: how many texts of each class the fit sees at most, chosen by a hash of doc_id; each is weighted by the rows
    it stands for. Null texts, labels and ids are not learned from.
    """
    known = labels.select("doc_id", label).where(F.col(label).isin(0, 1))
    chosen = label_sample(known, label, rows, modulus, HELD_OUT).toDF("doc_id", "y", "weight")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def run(batches):
        for batch in batches:
            bags = [[sorted({u for t in tokens_of(s) for u in units_of(t)}) for s in _SENTENCES.split(text)] for text in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.list_(pa.string())))], names=["y", "weight", "bag"])

    # at most 2 * `rows` short rows: a bounded broadcast, and a bounded sample of units comes back
    sample = texts.join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("double"), "weight", "text")
    found = sample.mapInArrow(run, "y double, weight double, bag array<array<string>>").toArrow()
    if not found.num_rows:
        return None
    bags = found.column("bag").to_pylist()
    order = sorted(range(len(bags)), key=lambda i: (found.column("y")[i].as_py(), bags[i]))  # the same for any order of arrival
    y, weight = np.asarray(found.column("y"))[order], np.asarray(found.column("weight"))[order]
    return fit_units([bags[i] for i in order], y, weight)


def score_toxicity(docs: DataFrame, model: ToxicModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and worst (the unit of the highest margin) of each row of `docs`.

    docs: doc_id, text; other columns are not looked at. The score is from 0 to 1, of the whole text. A text without
    units, null included, scores as the least toxic unit can; without a model every score is 0 and worst is null.
    Repeated rows each give a row; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks and one table of fixed size

    def run(batches):
        known: dict[str, tuple[float, str]] = {}
        own = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                best = []
                bags = [tokens_of(t) if own and t else () for t in texts[at : at + 256]]
                if len(known) > 300_000:
                    known.clear()
                new = sorted({t for bag in bags for t in bag if t not in known})
                parts = [units_of(t) for t in new]
                units = sorted({u for p in parts for u in p})
                margin = dict(zip(units, own.margins(units).tolist(), strict=True)) if units else {}
                for token, p in zip(new, parts, strict=True):
                    known[token] = max(((margin[u], u) for u in p), default=(-np.inf, ""))
                best = [max(map(known.__getitem__, bag), default=(-np.inf, "")) for bag in bags]
                margins = np.array([m for m, _ in best])
                score = own.scores(np.maximum(margins, -1e3)) if own else np.zeros(len(bags))
                worst = [u.strip(_EDGE) or None for _, u in best]
                yield pa.record_batch([batch.column(0).slice(at, len(bags)), score, (score >= threshold).astype(np.int32), pa.array(worst, pa.string())], names=["doc_id", "score", "predicted", "worst"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, worst string")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", F.coalesce(remainder(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
