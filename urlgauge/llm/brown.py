"""Brown's class-based bigram model: exchange clustering of words, smoothed transitions and emissions.

A token's probability is that of its class after the class before it, times that of the word in its class, mixed
with the add-one probability of the word alone. Counts of words cover every training text and stay in tables;
only tables of a fixed size reach the driver: the most frequent words, groups of the others by their ending, and
the counts of pairs of these units, on which the exchange algorithm finds the classes. Then every other training
word moves to the class that its own neighbours' classes make most likely, and the class bigrams are counted with
these final classes. Only words unseen in training keep their group's class.

Emissions take a fixed part of a count from every seen word of a class and give it to the class's unseen words, so
that each class's emissions, and with them each token's probabilities, sum to one (unseen words of a class being
one event, as the add-one base has it).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._samples import held_out, remainder
from urlgauge.llm._tables import row_key
from urlgauge.session import materialize

MODULUS = 7
CLASSES = 64
#: Words that are units of their own, and groups of all other words, in the exchange algorithm.
UNIT_WORDS = 1_024
GROUPS = 256
#: Words whose counts and classes every task holds; those of all others are joined.
HELD_WORDS = 1 << 18
ROUNDS = 6
DISCOUNT = 0.5
MIXED = 0.98
SMOOTHING = 20.0


#: Tokens whose neighbours a task combines before it passes them on.
SIDE_TOKENS = 1 << 20


def _groups(w: T.Words, which: np.ndarray) -> np.ndarray:
    """The group of each of these words (their places, or a flag for each), by its last three bytes."""
    starts, ends = w.starts[which], w.ends[which]
    return (T.short_hashes(w.data, np.maximum(starts, ends - 3), ends, 3) % np.uint64(GROUPS)).astype(np.int64)


def _word_counts(batches):
    for batch in batches:
        data, bounds = T.flat(batch.column(0))
        for a, b in T.chunks(bounds):
            w = T.words(data, bounds[a : b + 1])
            words, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            yield pa.record_batch([words.view(np.int64), _groups(w, first).astype(np.int32), n], names=["word", "grp", "n"])


def _units(w: T.Words, words: T.Places) -> np.ndarray:
    """Each word's unit: its own place among the sorted `words`, or after them its group."""
    units, known = words(w.hashes)
    units[~known] = len(words) + _groups(w, ~known)
    return units


def _pairs_before(values: np.ndarray, firsts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values with `end` after them, and what stands before each (`end` at first); and rows' bounds."""
    rows = len(firsts) - 1
    slots = np.arange(len(values)) + np.repeat(np.arange(rows), np.diff(firsts))
    after = np.full(len(values) + rows, end, np.int64)
    after[slots] = values
    before = np.concatenate([[end], after[:-1]])
    return before, after


def _pair_counts(sent):
    """How often each unit follows each, over all texts of a task."""

    def run(batches):
        words = T.Places(sent.value)
        end = len(words) + GROUPS
        counts = np.zeros((end + 1) ** 2, np.int64)
        for batch in batches:
            data, bounds = T.flat(batch.column(0))
            for a, b in T.chunks(bounds):
                w = T.words(data, bounds[a : b + 1])
                before, after = _pairs_before(_units(w, words), w.firsts, end)
                np.add.at(counts, before * (end + 1) + after, 1)
        pair = np.flatnonzero(counts)
        yield pa.record_batch([pair, counts[pair]], names=["pair", "n"])

    return run


def exchange(counts: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each unit: moves each unit, the frequent ones first, to the class that gives the bigrams most likelihood.

    counts[u, v]: how often unit v follows unit u. The last unit (the end of a text) keeps a class of its own.
    """
    units = len(counts)
    order = np.argsort(-(counts.sum(axis=1) + counts.sum(axis=0)), kind="stable")
    order = order[order != units - 1]
    of = np.zeros(units, np.int64)
    of[order] = np.arange(len(order)) % classes
    of[-1] = classes
    size = classes + 1
    member = np.zeros((units, size))
    member[np.arange(units), of] = 1
    after, before = counts @ member, counts.T @ member
    table = member.T @ after
    gain_of = lambda x: x * np.log(np.maximum(x, 1e-300))
    out, into = counts.sum(axis=1), counts.sum(axis=0)
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            a, own = of[u], counts[u, u]
            follow, lead = after[u].copy(), before[u].copy()
            follow[a] -= own
            lead[a] -= own
            table[a] -= follow
            table[:, a] -= lead
            table[a, a] -= own
            np.maximum(table, 0, out=table)
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            down, across = table[:classes], table[:, :classes].T
            total = (gain_of(down + follow) - gain_of(down)).sum(axis=1) + (gain_of(across + lead) - gain_of(across)).sum(axis=1)
            middle = table[diagonal, diagonal]
            total -= gain_of(middle + follow[:classes]) + gain_of(middle + lead[:classes]) - 2 * gain_of(middle)
            total += gain_of(middle + follow[:classes] + lead[:classes] + own) - gain_of(middle)
            total -= gain_of(rows[:classes] + out[u]) - gain_of(rows[:classes]) + gain_of(columns[:classes] + into[u]) - gain_of(columns[:classes])
            b = a if total[a] >= total.max() - 1e-9 else int(np.argmax(total))
            table[b] += follow
            table[:, b] += lead
            table[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                for side, line in ((after, counts[:, u]), (before, counts[u])):
                    side[:, a] -= line
                    side[:, b] += line
        if not moved:
            break
    return of


def _neighbours(sent):
    """(word, neighbouring class, n) of each word that is no unit; classes on the right come after those on the left."""

    def run(batches):
        words, of = sent.value
        units, end = T.Places(words), int(of[-1])
        kept, tokens = [], 0
        for batch in batches:
            data, bounds = T.flat(batch.column(0))
            for a, b in T.chunks(bounds):
                w = T.words(data, bounds[a : b + 1])
                unit = _units(w, units)
                before, after = _pairs_before(of[unit], w.firsts, end)
                place = np.flatnonzero(unit >= len(units))
                slots = place + w.rows[place]
                kept.append((w.hashes[place], before[slots].astype(np.int32), after[slots + 1].astype(np.int32)))
                tokens += len(place)
                if tokens >= SIDE_TOKENS:
                    yield _sides(kept, end)
                    kept, tokens = [], 0
        if kept:
            yield _sides(kept, end)

    return run


def _sides(kept: list[tuple[np.ndarray, ...]], end: int) -> pa.RecordBatch:
    hashes, left, right = (np.concatenate(x) for x in zip(*kept, strict=True))
    words, at = np.unique(hashes, return_inverse=True)
    sides = 2 * (end + 1)
    code = np.concatenate([at * sides + left, at * sides + end + 1 + right])
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    n = np.diff(np.append(first, len(code)))
    code = code[first]
    return pa.record_batch([words[code // sides].view(np.int64), (code % sides).astype(np.int32), n], names=["word", "side", "n"])


def fitting(follow: np.ndarray) -> np.ndarray:
    """What one neighbour adds to the log likelihood of each class: rows are left classes, then right ones.

    follow: counts of class pairs, the end last. The end is no choice, nor is a class without any token.
    """
    size = len(follow)
    left = np.log((follow + 0.5) / (follow.sum(axis=0) + 0.5 * size))
    right = np.log((follow + 0.5) / (follow.sum(axis=1, keepdims=True) + 0.5 * size)).T
    out = np.concatenate([left, right])[:, : size - 1]
    out[:, follow.sum(axis=0)[: size - 1] == 0] = -1e3
    return out


def _placed(sent):
    """Each word's count and best class, from its neighbours' classes; rows come sorted by word."""

    def best(words, counts):
        gain = sent.value
        return pa.record_batch([words, counts[:, : len(gain) // 2].sum(axis=1).astype(np.int64), (counts @ gain).argmax(axis=1).astype(np.int32)], names=["word", "n", "cls"])

    def run(batches):
        sides = len(sent.value)
        last, last_counts = np.zeros(0, np.int64), np.zeros((0, sides))  # the next batch may go on with this word
        for batch in batches:
            if not batch.num_rows:
                continue
            word, side, n = (np.asarray(x) for x in batch.columns)
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            words = word[new]
            counts = np.bincount((np.cumsum(new) - 1) * sides + side, n, len(words) * sides).reshape(-1, sides)
            if len(last) and last[0] == words[0]:
                counts[0] += last_counts[0]
            else:
                words, counts = np.concatenate([last, words]), np.concatenate([last_counts, counts])
            yield best(words[:-1], counts[:-1])
            last, last_counts = words[-1:], counts[-1:]
        yield best(last, last_counts)

    return run


@dataclass
class BrownModel:
    """Tables of a fixed size, and `rest`: the stored counts and classes of the words that the tables leave out."""

    train_tokens: int
    distinct: int
    transition: np.ndarray
    tokens: np.ndarray
    types: np.ndarray
    held: np.ndarray
    held_counts: np.ndarray
    held_classes: np.ndarray
    group_classes: np.ndarray
    rest: DataFrame | None

    def tables(self) -> tuple:
        return self.total(), self.factors(), self.held, self.held_counts, self.held_classes, self.group_classes, int(self.tokens[-1]), len(self.tokens) - 1

    def total(self) -> int:
        return self.train_tokens + self.distinct + 1

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By class before and class: what a count is multiplied with, what an unseen word has; and each class's discount."""
        end = len(self.tokens) - 1
        discount = np.full(end + 1, DISCOUNT)
        discount[end] = 0.0
        seen = np.divide(MIXED * self.transition, self.tokens, out=np.zeros_like(self.transition), where=self.tokens > 0)
        return seen, seen * discount * self.types, discount


def fit_brown(docs: DataFrame, classes: int = CLASSES, unit_words: int = UNIT_WORDS) -> BrownModel:
    """A model of all rows of `docs` (text). Null and empty texts are an end alone; an empty table is learned, too."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = texts.count()
    counts = materialize(texts.mapInArrow(_word_counts, "word bigint, grp int, n bigint").groupBy("word", "grp").agg(F.sum("n").alias("n")))
    by_group = counts.groupBy("grp").agg(F.count("*").alias("types")).collect()  # at most GROUPS rows
    # the least count of the held words: from a histogram by sixteenths of an octave, at most 1024 rows
    cell = F.floor(16 * F.log2(F.col("n").cast("double")))
    histogram = sorted(counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True)
    least, words = 1 << 62, 0
    for _, more, low in histogram:
        words += more
        if words > HELD_WORDS:
            break
        least = low
    held = counts.where(F.col("n") >= least).toArrow()
    word, grp, n = (np.asarray(held.column(i)) for i in range(3))
    word = word.view(np.uint64)
    order = np.argsort(word)
    word, grp, n = word[order], grp[order], n[order]
    own = np.sort(np.lexsort((word, -n))[:unit_words])  # places of the unit words, in the order of their hashes
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(word[own])
    units = len(own) + GROUPS + 1
    pairs = texts.mapInArrow(_pair_counts(sent), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most units squared
    table = np.zeros(units * units)
    table[np.asarray(pairs.column(0))] = np.asarray(pairs.column(1))
    table = table.reshape(units, units)
    of = exchange(table, classes)
    member = np.zeros((units, classes + 1))
    member[np.arange(units), of] = 1
    known = spark.sparkContext.broadcast((word[own], of))
    gain = spark.sparkContext.broadcast(fitting(member.T @ table @ member))
    # tasks have combined what they found, so a word has few rows of each side; they are added up as they come
    sides = texts.mapInArrow(_neighbours(known), "word bigint, side int, n bigint").repartition("word").sortWithinPartitions("word")
    placed = materialize(sides.mapInArrow(_placed(gain), "word bigint, n bigint, cls int"))
    held_classes = np.zeros(len(word), np.int64)
    more = placed.where(F.col("n") >= least).select("word", "cls").toArrow()
    held_classes[np.searchsorted(word, np.asarray(more.column(0)).view(np.uint64))] = np.asarray(more.column(1))
    held_classes[own] = of[: len(own)]
    group_classes = of[len(own) : len(own) + GROUPS]
    rest = placed.where(F.col("n") < least)
    total, types = np.bincount(of[: len(own)], n[own], classes + 1), np.bincount(of[: len(own)], minlength=classes + 1).astype(float)
    for r in placed.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # at most `classes` rows
        total[r["cls"]] += r["n"]
        types[r["cls"]] += r["types"]
    total[classes], types[classes] = rows, min(rows, 1)
    follow = _followers(texts, (0, None, word, n, held_classes, group_classes, rows, classes), rest)
    share = total / max(total.sum(), 1)
    transition = (follow + SMOOTHING * share) / (follow.sum(axis=1, keepdims=True) + SMOOTHING)
    distinct = sum(r["types"] for r in by_group) + min(rows, 1)
    return BrownModel(int(total.sum()), int(distinct), transition, total, types, word, n, held_classes, group_classes, rest)


def _scored(sent):
    """Each text's tokens, seen ones, and sums of both scores, as far as held words and the end give them."""

    def run(batches):
        held = T.Places(sent.value[2])
        for batch in batches:
            yield from _in_parts(batch, sent.value, held)

    return run


#: A word that is not held, and its class if it is unseen; the word before it if that is not held either (else itself),
#: and that one's class, or its class if it is unseen; class and count of the held word or end after it, or -1.
RARE = "row bigint, word bigint, cls int, chained boolean, before_word bigint, before int, after int, after_n bigint, n_pairs bigint"


def _rare(sent, held_pairs: bool = False):
    """A row (RARE) for each word that is not held; if asked, also one for each pair of held ones, with its count."""

    def run(batches):
        held, size = T.Places(sent.value[2]), sent.value[7] + 1
        pairs = np.zeros(size * size, np.int64)
        for batch in batches:
            yield from _rare_parts(batch, sent.value, held, pairs if held_pairs else None)
        pair = np.flatnonzero(pairs)
        first, second, none = (pair // size).astype(np.int32), (pair % size).astype(np.int32), np.zeros(len(pair), np.int64)
        columns = [none, pair, first, none.astype(bool), pair, first, second, none, pairs[pair]]
        yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in RARE.split(", ")])

    return run


def _classed(w: T.Words, tables, held: T.Places):
    """Of each word: its place in the held ones, whether it is there, and its class, the group's if it is not held."""
    _, _, _, _, held_classes, group_classes, *_ = tables
    at, known = held(w.hashes)
    kinds = np.zeros(len(at), np.int64)
    kinds[known] = held_classes[at[known]]
    kinds[~known] = group_classes[_groups(w, ~known)]
    return at, known, kinds


def _rare_parts(batch, tables, held: T.Places, pairs: np.ndarray | None):
    counts, end_count, end = tables[3], tables[6], tables[7]
    data, bounds = T.flat(batch.column(2))
    for a, b in T.chunks(bounds):
        w = T.words(data, bounds[a : b + 1])
        at, known, kinds = _classed(w, tables, held)
        before, after = _pairs_before(kinds, w.firsts, end)
        # the ends count as held
        before_held, after_held = _pairs_before(known, w.firsts, 1)
        n = np.full(len(after), end_count, np.int64)
        slots = np.arange(len(kinds)) + w.rows
        n[slots] = 0
        n[slots[known]] = counts[at[known]]
        place = np.flatnonzero(~known)
        own, words = slots[place], w.hashes.view(np.int64)
        chained = before_held[own] == 0
        columns = [
            batch.column(1).slice(a, b - a).take(pa.array(w.rows[place])), words[place], kinds[place].astype(np.int32), chained, np.where(chained, words[place - 1], words[place]),
            before[own].astype(np.int32), np.where(after_held[own + 1] == 1, after[own + 1], -1).astype(np.int32), n[own + 1], np.zeros(len(place), np.int64),
        ]
        yield pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in RARE.split(", ")])
        if pairs is not None:
            both = (before_held == 1) & (after_held == 1)
            pairs += np.bincount(before[both] * (end + 1) + after[both], minlength=len(pairs))


def _with_classes(rare: DataFrame, rest: DataFrame) -> DataFrame:
    """RARE with counts (n) and classes of both words from `rest`; unseen ones keep their group's class."""
    rare = rare.withColumnRenamed("cls", "group_cls").join(rest, "word", "left").withColumn("cls", F.coalesce("cls", "group_cls"))
    before = rest.select(F.col("word").alias("before_word"), F.col("cls").alias("before_cls"))
    return rare.join(before, "before_word", "left").withColumn("before", F.when(F.col("chained"), F.coalesce("before_cls", "before")).otherwise(F.col("before")))


def _followers(texts: DataFrame, tables: tuple, rest: DataFrame) -> np.ndarray:
    """How often each class, or an end, follows each: over every pair of all words."""
    size = tables[-1] + 1
    sent = texts.sparkSession.sparkContext.broadcast(tables)
    none = F.lit(0).cast("bigint")
    found = texts.select(none.alias("doc_id"), none.alias("row"), "text").mapInArrow(_rare(sent, held_pairs=True), RARE)
    rare = _with_classes(found, rest)
    own = F.struct((F.col("before") * size + F.col("cls")).alias("pair"), F.lit(1).cast("bigint").alias("n"))
    following = F.struct((F.col("cls") * size + F.col("after")).alias("pair"), F.lit(1).cast("bigint").alias("n"))
    held = F.struct((F.col("before") * size + F.col("after")).alias("pair"), F.col("n_pairs").alias("n"))
    pairs = F.when(F.col("n_pairs") > 0, F.array(held)).when(F.col("after") >= 0, F.array(own, following)).otherwise(F.array(own))
    sums = rare.select(F.explode(pairs).alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n")).toArrow()  # at most classes squared
    follow = np.zeros(size * size)
    follow[np.asarray(sums.column(0))] = np.asarray(sums.column(1))
    return follow.reshape(size, size)


def _in_parts(batch, tables, held: T.Places):
    total, (seen, _, discount), _, counts, _, _, end_count, end = tables
    data, bounds = T.flat(batch.column(2))
    for a, b in T.chunks(bounds):
        w = T.words(data, bounds[a : b + 1])
        at, known, kinds = _classed(w, tables, held)
        before, after = _pairs_before(kinds, w.firsts, end)
        before_held, own = _pairs_before(known, w.firsts, 1)
        slots = np.arange(len(kinds)) + w.rows
        n = np.zeros(len(after), np.int64)
        n[slots[known]] = counts[at[known]]
        ends = w.firsts[1:] + np.arange(b - a)
        n[ends] = end_count
        own = own == 1
        alone = own & (before_held == 1)
        base = np.log10((n + 1) / total)
        p = seen[before, after] * (n - discount[after]) + (1 - MIXED) * (n + 1) / total if end_count else (n + 1) / total
        score = np.log10(np.maximum(p, 1e-300))
        of = np.repeat(np.arange(b - a), np.diff(w.firsts) + 1)
        sums = [np.bincount(of, np.where(mask, x, 0.0), b - a).astype(float) for x, mask in ((base, own), (score, alone))]
        found = np.bincount(of[own & (n > 0)], minlength=b - a)
        yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), np.diff(w.firsts) + 1, found, *sums], names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score"])


def score_brown(docs: DataFrame, model: BrownModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of `docs`.

    docs: doc_id, text; other columns are not looked at. Tokens are the text's words in lower case (A-Z) between
    ASCII white space, and one end; a null or empty text is an end alone. base_score sums log10((c + 1) / (N + V +
    1)), score the model's log10 probabilities. Without training texts both are 0. Repeated rows each give a row.

    Words that the tables hold are scored in place. The others meet their counts and classes in a join by word, and
    in a second one by the word before; their sums, and those of what follows them, go back to their texts. None of
    these words is frequent, so neither side has a hot key.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", row_key().alias("row"), "text")
    sent = spark.sparkContext.broadcast(model.tables())
    held = rows.mapInArrow(_scored(sent), f"doc_id {kind}, row bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    held = held.groupBy("row").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("doc_id", "n_tokens", "n_known", "base_score", "score")))
    rare = _with_classes(rows.mapInArrow(_rare(sent), RARE), model.rest)
    seen, unseen, discount = model.factors()
    size = len(discount)
    factors = [(i, float(seen.flat[i]), float(unseen.flat[i]), float(discount[i % size])) for i in range(size * size)]
    pairs = F.broadcast(spark.createDataFrame(factors, "pair int, seen double, unseen double, discount double"))  # classes squared
    after = pairs.select(*(F.col(c).alias(f"after_{c}") for c in ("pair", "seen", "discount")))
    n, total = F.coalesce("n", F.lit(0)), float(model.total())
    mixed = (1 - MIXED) if model.train_tokens else 1.0
    p = F.when(F.col("n").isNotNull(), F.col("seen") * (n - F.col("discount"))).otherwise(F.col("unseen")) + mixed * (n + 1) / total
    after_p = F.col("after_seen") * (F.col("after_n") - F.col("after_discount")) + mixed * (F.col("after_n") + 1) / total
    rare = rare.withColumn("pair", F.col("before") * size + F.col("cls")).join(pairs, "pair")
    rare = rare.withColumn("after_pair", F.when(F.col("after") >= 0, F.col("cls") * size + F.col("after"))).join(after, "after_pair", "left")
    sums = rare.groupBy("row").agg(
        F.count("n").alias("more"), F.sum(F.log10((n + 1) / total)).alias("more_base"), F.sum(F.log10(p) + F.coalesce(F.log10(after_p), F.lit(0.0))).alias("more_score")
    )
    both = held.join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b) / F.col("copies"), F.lit(0))
    out = both.select(
        "doc_id", "n_tokens", plus("n_known", "more").cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        plus("base_score", "more_base").alias("base_score"), plus("score", "more_score").alias("score"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))),
    ).drop("col")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_brown(docs, fit_brown(docs.where(remainder(MODULUS) != 2)))
    return found.select("doc_id", held_out(MODULUS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
