"""Collocations: phrases whose parts meet far more often than chance, counted in HAT-tries.

Each task counts the phrases of its texts in tries over word numbers, shallow because their leaves are hash containers
that hold the rest of the phrase. A container that grows too large bursts into one container per next word. When a trie
holds too many phrases, its largest subtrees leave as sorted runs; the rest stays and goes on collecting. The runs are
dealt by the prefix of the phrase and merged there by a sum.

Most phrases are rare, and these never enter a trie: hashes of phrases are counted first, which takes no strings. A
hash counts at least as often as each phrase behind it, so what stays below the threshold is settled. A phrase is never
more frequent than its parts, so longer ones are only looked at where their parts have passed. What has passed is sent
on as bit tables of fixed size; what they let through wrongly is counted like the rest and falls to the exact threshold,
so results do not depend on their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm.oracles import LOWER, UPPER
from urlgauge.session import materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Phrases that a container holds before it bursts, and that a trie holds before subtrees leave it.
BURST, HELD = 4_096, 400_000
#: Words of the prefix by which runs are dealt, and phrases that one part holds as a rule.
PREFIX, PART_PHRASES = 3, 200_000
#: Different hashes that a task holds before it passes them on.
HELD_HASHES = 3_000_000
#: Bits of the table of frequent phrases, and bits set for each.
FILTER_BITS, FILTER_HASHES = 1 << 26, 2
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_CUTS = _BREAKS.copy()
_CUTS[[9, 32]] = True


class Branch:
    """An inner node: children by word number."""

    def __init__(self):
        self.children: dict[int, Branch | dict[bytes, int]] = {}


class HatTrie:
    """Counts of phrases of `length` word numbers; leaves are hash containers keyed by the rest of a phrase."""

    def __init__(self, length: int, burst: int = BURST):
        self.length, self.burst, self.size = length, burst, 0
        self.root: Branch | dict[bytes, int] = {}

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """phrases: different rows of word numbers."""
        if not len(phrases):
            return
        keys, root = _keys(phrases), self.root
        if isinstance(root, dict):
            self.root = self._put(root, keys, counts.tolist(), 0)
            return
        children = root.children
        for word, key, count in zip(phrases[:, 0].tolist(), keys, counts.tolist(), strict=True):
            node, rest = children.get(word), key[4:]
            if type(node) is dict:
                if rest in node:
                    node[rest] += count
                    continue
                node[rest] = count
                self.size += 1
                if len(node) > self.burst and self.length > 2:
                    children[word] = self._burst(node)
            else:
                children[word] = self._put({} if node is None else node, [rest], [count], 1)

    def _put(self, node, keys: list[bytes], counts: list[int], depth: int):
        """Adds rests of phrases below a node; gives the node, or the branch that it has become."""
        if isinstance(node, dict):
            before, get = len(node), node.get
            for key, count in zip(keys, counts, strict=True):
                node[key] = get(key, 0) + count
            self.size += len(node) - before
            return self._burst(node) if len(node) > self.burst and depth < self.length - 1 else node
        for key, count in zip(keys, counts, strict=True):
            word = int.from_bytes(key[:4], "big")
            node.children[word] = self._put(node.children.get(word, {}), [key[4:]], [count], depth + 1)
        return node

    @staticmethod
    def _burst(container: dict[bytes, int]) -> Branch:
        branch = Branch()
        for key, count in container.items():
            branch.children.setdefault(int.from_bytes(key[:4], "big"), {})[key[4:]] = count
        return branch

    def subtrees(self) -> list[tuple[tuple[int, ...], Branch | dict[bytes, int], int]]:
        """Path, node and phrases of the root's children, the largest first (the root itself while it is a container)."""
        if isinstance(self.root, dict):
            return [((), self.root, len(self.root))]
        found = [((word,), node, _phrases(node)) for word, node in self.root.children.items()]
        return sorted(found, key=lambda x: (-x[2], x[0]))

    def spill(self, down_to: int, together: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes whole subtrees out until `down_to` phrases are left: phrases and counts, of small subtrees `together`."""
        keys: list[bytes] = []
        counts: list[int] = []
        for path, node, held in self.subtrees():
            if self.size <= down_to:
                break
            if path:
                del self.root.children[path[0]]
            else:
                self.root = {}
            self.size -= held
            _leaves(b"".join(w.to_bytes(4, "big") for w in path), node, keys, counts)
            if len(keys) >= together:
                yield _unpacked(keys, counts, self.length)
                keys, counts = [], []
        if keys:
            yield _unpacked(keys, counts, self.length)


def _keys(rest: np.ndarray) -> list[bytes]:
    width = 4 * rest.shape[1]
    return np.ascontiguousarray(rest.astype(">u4")).view(f"V{width}").ravel().tolist()


def _phrases(node) -> int:
    return len(node) if isinstance(node, dict) else sum(map(_phrases, node.children.values()))


def _leaves(path: bytes, node, keys: list[bytes], counts: list[int]) -> None:
    if isinstance(node, dict):
        keys.extend([path + rest for rest in node])
        counts.extend(node.values())
        return
    for word, child in node.children.items():
        _leaves(path + word.to_bytes(4, "big"), child, keys, counts)


def _unpacked(keys: list[bytes], counts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(keys), ">u4").reshape(-1, length).astype(np.int64), np.array(counts, np.int64)


def _language_hash(lang: str) -> int:
    value = 0xCBF29CE484222325
    for byte in lang.encode():
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def _bit_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(T.mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64) for i in range(FILTER_HASHES)]


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for place in _bit_places(hashes, len(table) * 8):
        ok &= (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return ok


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of the columns, in order, and how often each occurs."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * (int(column.max(initial=0)) + 1) + column
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return np.stack([c[first] for c in columns], axis=1), counts


class _Chunk:
    """The words of some texts, with the language in their hashes, and which runs of words are phrases."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kinds: list[str]):
        self.words = w = T.words(data, bounds, _CUTS)
        known = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
        self.names = list(known)
        salt = T.mix(np.array([_language_hash(k) for k in known], np.uint64))
        self.code = np.array([known[k] for k in kinds], np.int64)[w.rows]
        self.hashes = w.hashes ^ salt[self.code] if len(w.hashes) else w.hashes
        self.hasher = T.Hasher(self.hashes)
        self.piece = np.concatenate([[0], np.cumsum(_BREAKS[w.data])])[w.starts]

    def phrases(self, length: int) -> np.ndarray:
        rows = self.words.rows
        at = np.arange(max(len(rows) - length + 1, 0))
        end = at + length - 1
        return at[(rows[at] == rows[end]) & (self.piece[at] == self.piece[end])]


def _chunks(batches):
    for batch in batches:
        data, bounds = T.flat(batch.column(1))
        kinds = batch.column(0).to_pylist()
        for a, b in T.chunks(bounds):
            yield _Chunk(data, bounds[a : b + 1], kinds[a:b])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _hash_counts(lengths: range, known: int, table):
    """(words, h, lang, n): counted hashes of a task's phrases whose runs of `known` words have passed; words 0: all words."""

    def run(batches):
        held: dict[int, list] = {k: [] for k in lengths}
        size, totals = 0, {}

        def out(down_to: int):
            nonlocal size
            size = 0
            for k in lengths:
                if held[k]:
                    held[k] = [_added(held[k])]
                    size += len(held[k][0][0])
            if size > down_to:
                for k in lengths:
                    for hashes, counts in held[k]:
                        yield pa.record_batch([np.full(len(hashes), k, np.int32), hashes.view(np.int64), pa.nulls(len(hashes), pa.string()), counts], names=["words", "h", "lang", "n"])
                    held[k] = []
                size = 0

        for chunk in _chunks(batches):
            if 1 in lengths:
                for name, n in zip(chunk.names, np.bincount(chunk.code, minlength=len(chunk.names)).tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
            good = _passes(table.value, chunk.hasher.runs(known)) if table is not None else None
            for k in lengths:
                spots = chunk.phrases(k)
                for shift in range(k - known + 1) if good is not None else ():
                    spots = spots[good[spots + shift]]
                if len(spots):
                    found = np.unique(chunk.hasher.runs(k)[spots], return_counts=True)
                    held[k].append(found)
                    size += len(found[0])
            if size > HELD_HASHES:
                yield from out(HELD_HASHES // 2)
        yield from out(-1)
        rows = [n for n in totals.items() if n[1]]
        yield pa.record_batch([np.zeros(len(rows), np.int32), pa.nulls(len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["words", "h", "lang", "n"])

    return run


def _tables(passed: DataFrame, lengths: range, bits: int) -> list[np.ndarray]:
    """Bit tables of the hashes that have passed, one for each length; of fixed size, whatever their number."""

    def run(batches):
        for batch in batches:
            hashes = np.asarray(batch.column(1)).view(np.uint64)
            for place in _bit_places(hashes, bits):
                yield pa.record_batch([batch.column(0), place], names=["words", "place"])

    places = passed.select("words", "h").mapInArrow(run, "words int, place bigint")
    parts = places.groupBy("words", F.bitmap_bucket_number(F.col("place") + 1).alias("part"))
    out = {k: np.zeros(max(bits // 8, 4096), np.uint8) for k in lengths}
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bitmap")).toLocalIterator():
        at = (row["part"] - 1) * 4096
        out[row["words"]][at : at + 4096] = np.frombuffer(row["bitmap"], np.uint8)
    return [out[k][: bits // 8] for k in lengths]


_RUN = "part int, words int, lang string, phrases array<string>, counts array<bigint>"


def _counter(tables, parts: int, held: int, burst: int):
    """Sorted runs of counted phrases (a row for each part, length and language) of a task's texts.

    Only phrases whose own hashes have passed are counted. A phrase's part follows from its language and prefix.
    """

    def run(batches):
        numbers: dict[tuple[str, int], int] = {}
        names: list[bytes] = []
        langs: list[str] = []
        tries = [HatTrie(k + 1, burst) for k in range(len(tables.value))]

        def out(runs, length):
            for phrases, counts in runs:
                rows = []
                for own, n in zip(phrases.tolist(), counts.tolist(), strict=True):
                    lang, text = langs[own[0]], [names[w] for w in own]
                    rows.append((crc32(b" ".join(text[:PREFIX]), crc32(lang.encode())) % parts, lang, b" ".join(text), n))
                rows.sort()
                found = [(*key, *zip(*((r[2], r[3]) for r in group), strict=True)) for key, group in groupby(rows, key=lambda r: r[:2])]
                part, lang, text, n = zip(*found, strict=True)
                yield pa.record_batch([pa.array(part, pa.int32()), np.full(len(part), length, np.int32), pa.array(lang, pa.string()), pa.array(text, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(n, pa.list_(pa.int64()))], names=["part", "words", "lang", "phrases", "counts"])

        for chunk in _chunks(batches):
            w = chunk.words
            number = np.full(len(w.hashes), -1, np.int64)
            for length, (trie, table) in enumerate(zip(tries, tables.value, strict=True), 1):
                spots = chunk.phrases(length)
                spots = spots[_passes(table, chunk.hasher.runs(length)[spots])]
                if not len(spots):
                    continue
                # numbers of the words by language, the same for all texts of the task
                needed = np.unique((spots[:, None] + np.arange(length)).ravel())
                needed = needed[number[needed] < 0]
                _, one, which = np.unique(chunk.hashes[needed], return_index=True, return_inverse=True)
                first = needed[one]
                own = np.empty(len(first), np.int64)
                for i, (h, at, c) in enumerate(zip(chunk.hashes[first].tolist(), first.tolist(), chunk.code[first].tolist(), strict=True)):
                    n = numbers.get((chunk.names[c], h))
                    if n is None:
                        n = numbers[(chunk.names[c], h)] = len(names)
                        names.append(w.data[w.starts[at] : w.ends[at]].tobytes())
                        langs.append(chunk.names[c])
                    own[i] = n
                number[needed] = own[which]
                trie.add(*_distinct([number[spots + i] for i in range(length)]))
                if trie.size > held:
                    yield from out(trie.spill(held // 2), length)
        for length, trie in enumerate(tries, 1):
            yield from out(trie.spill(-1), length)

    return run


def _merged(least: int):
    """(lang, words, phrase, f) of the phrases in a task's runs that occur `least` times; holds each phrase once."""

    def run(batches):
        total: dict[tuple[str, int], dict[str, int]] = {}
        for batch in batches:
            for words, lang, phrases, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                own = total.setdefault((lang, words), {})
                get = own.get
                for phrase, n in zip(phrases, counts, strict=True):
                    own[phrase] = get(phrase, 0) + n
        for (lang, words), own in total.items():
            kept = [(p, n) for p, n in own.items() if n >= least]
            for at in range(0, len(kept), 20_000):
                phrase, n = zip(*kept[at : at + 20_000], strict=True)
                yield pa.record_batch([pa.array([lang] * len(n), pa.string()), np.full(len(n), words, np.int32), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=["lang", "words", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, held: int = HELD, burst: int = BURST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to `longest` words that occur `least` times, and (lang, n): all words.

    docs: lang (null: und), text. See `collocations` for what a phrase is. Both are stored tables.
    """
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    tables, totals, passed = [], None, 0
    for lengths in (range(1, 2), range(2, min(longest, 2) + 1), range(3, longest + 1)):
        if not lengths:
            continue
        known = lengths[0] - 1
        counted = texts.mapInArrow(_hash_counts(lengths, known, send(tables[-1]) if tables else None), "words int, h bigint, lang string, n bigint")
        summed = counted.groupBy("words", "h", "lang").agg(F.sum("n").alias("n")).where((F.col("words") == 0) | (F.col("n") >= least))
        summed = materialize(summed)
        totals = summed.where("words = 0").select("lang", "n") if totals is None else totals
        passed += summed.where("words > 0").count()
        tables += _tables(summed.where("words > 0"), lengths, bits)
    # as many parts as keep the phrases that have passed, each held once, small in every task
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-passed // PART_PHRASES))
    runs = texts.mapInArrow(_counter(send(tables), parts, held, burst), _RUN)
    merged = runs.repartition(parts, "part").mapInArrow(_merged(least), "lang string, words int, phrase string, f bigint")
    return materialize(merged), totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, **memory: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the `top` phrases of each language.

    docs: lang, text; other columns are not looked at. Texts are put in lower case (A-Z), cut at `.,;:!?` and line ends
    into pieces, and these at blanks and tabs into words; phrases never leave a piece. Null texts and empty ones have
    none; a null lang counts as `und`. Phrases of 2 to `longest` words that occur `least` times (a) are candidates, scored
    by floor(1000 * a * n / (l * r)) at the cut that gives the least (ties: the first one), with n all words of the
    language, l and r the counts of both parts. A phrase inside a longer candidate of the same count goes. Ties in rank:
    higher a, then the phrase in byte order. An empty table gives no rows. memory: `held`, `burst`, `bits`, which results
    do not depend on.
    """
    counts, totals = phrase_counts(docs, longest, least, **memory)
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    at = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = candidates.select("*", at).select("*", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    half = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(half("left", "l"), ["lang", "left"]).join(half("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), "below": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("above div below").cast("bigint"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    within = _shorter_inside(candidates, words).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where("longer is null or longer < a").select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _shorter_inside(candidates: DataFrame, words: Column) -> DataFrame:
    """(lang, phrase, a): each shorter phrase of two words or more inside a candidate, with the candidate's count."""
    sizes = candidates.where("words > 2").select("lang", "a", "words", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    starts = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    return starts.select("lang", F.array_join(F.slice("w", F.col("first"), F.col("size")), " ").alias("phrase"), "a")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k)
  ) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND f >= {LEAST}
), s AS (
  SELECT c.lang, c.phrase, c.a, i, x.f AS l, y.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[i + 1:c.k], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), inside AS (
  SELECT lang, array_to_string(v[first:first + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS first FROM (SELECT *, unnest(range(2, k)) AS size FROM c)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a
QUALIFY rank <= {TOP}
"""
