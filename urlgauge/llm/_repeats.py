"""Windows of a fixed length that start more than once anywhere in a table of texts.

A text is a sequence of bytes or of words. Each window takes the smallest hash of the runs inside it as its anchor
(a minimiser), so equal windows always share an anchor at the same relative place. Windows that follow each other
and share an anchor form a segment. What repeats is then found in steps whose volume shrinks:

1. anchors are counted over the table, with partial aggregation; the ones that occur once are done;
2. an anchor whose segments are all equal repeats as a whole; copies go no further;
3. of the other anchors, one copy of each distinct segment is fetched, and an engine (suffix arrays, automata)
   decides within the anchor's group which of its windows repeat. Groups are dealt over tasks by anchor. A group of more
   than GROUP distinct segments is first dealt by finer anchors: its windows are halved by where they hold the anchor,
   and each half's key is all that its windows have in common, which is half as far from a whole window as before.
   Equal parts become one, and parts are halved again until each group fits; the engine decides all of them. A segment
   gives a few parts a level, not one for each window, as only the part at the edge of a common passage stays large.
4. the answer goes back to each text by its segments.

Rows are told apart by doc_id and a hash of doc_id and text: repeated rows count as copies of each other, and get
the same answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlgauge.llm import _text as T
from urlgauge.llm._tables import small_list
from urlgauge.session import materialize

#: Distinct segments that an engine looks at together; larger groups are dealt by finer anchors first.
GROUP = 2_000
#: Bytes of segments that an engine gets at once.
ENGINE_BYTES = 1 << 18


@dataclass(frozen=True)
class Unit:
    """What a window consists of: bytes, or words (unchanged, between ASCII white space)."""

    window: int
    gram: int
    by_word: bool

    def elements(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, T.Words | None]:
        """Values to hash, the row of each, the first of each row, and the words if there are any."""
        if self.by_word:
            w = T.words(data, bounds, T.SPACES, lower=False)
            return w.hashes, w.rows, w.firsts, w
        sizes = np.diff(bounds)
        return data[bounds[0] : bounds[-1]], np.repeat(np.arange(len(sizes)), sizes), bounds - bounds[0], None


@dataclass
class Segments:
    """Segments of some rows: row, anchor and own hash, anchor place, and elements before and from it on."""

    row: np.ndarray
    anchor: np.ndarray
    seg: np.ndarray
    place: np.ndarray
    before: np.ndarray
    after: np.ndarray


def segments(unit: Unit, values: np.ndarray, rows: np.ndarray) -> Segments:
    n = len(values) - unit.window + 1
    if n <= 0:
        return Segments(*(np.zeros(0, np.int64),) * 6)
    hasher = T.Hasher(values)
    grams = hasher.runs(unit.gram)
    place, first, last = T.minimisers(grams, unit.window - unit.gram + 1, rows[:n] == rows[unit.window - 1 :])
    before, end = place - first, last + unit.window
    seg = T.mix(hasher(first, end) ^ (grams[place] + before.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return Segments(rows[first], grams[place].view(np.int64), seg.view(np.int64), place, before, end - place)


def _marks(unit: Unit):
    """Distinct segments of each row, with their number in it and the place of the first one's anchor."""

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(2))
            for a, b in T.chunks(bounds):
                values, rows, firsts, _ = unit.elements(data, bounds[a : b + 1])
                s = segments(unit, values, rows)
                order = np.lexsort((s.place, s.seg, s.row))
                new = np.ones(len(order), bool)
                new[1:] = (s.row[order][1:] != s.row[order][:-1]) | (s.seg[order][1:] != s.seg[order][:-1])
                heads = np.flatnonzero(new)
                at = order[heads]
                pick = pa.array(a + s.row[at])
                yield pa.record_batch(
                    [batch.column(0).take(pick), batch.column(1).take(pick), s.anchor[at], s.seg[at], np.diff(np.append(heads, len(order))), s.place[at] - firsts[s.row[at]], s.before[at], s.after[at]],
                    names=["doc_id", "row", "anchor", "seg", "n", "at", "before", "after"],
                )

    return T.giving_back(run)


def _contents(unit: Unit):
    """Of (doc_id, row, wanted, text), the elements of each wanted segment."""

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column(3))
            wanted = batch.column(2)
            at, sizes = wanted.flatten(), np.diff(np.asarray(wanted.offsets))
            field = lambda name: np.asarray(at.field(name))
            place, before, after = field("at"), field("before"), field("after")
            parts, done = [], 0
            for a, b in T.chunks(bounds):
                _, _, firsts, w = unit.elements(data, bounds[a : b + 1])
                for row in range(a, b):
                    for _ in range(sizes[row]):
                        x = int(firsts[row - a] + place[done])
                        x, y = x - int(before[done]), x + int(after[done])
                        parts.append(w.text(x, y) if w else data[bounds[a] + x : bounds[a] + y].tobytes())
                        done += 1
            pick = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.record_batch([at.field("anchor"), at.field("seg"), at.field("n"), batch.column(0).take(pick), batch.column(1).take(pick), at.field("at"), at.field("before"), pa.array(parts, pa.binary())], names=["anchor", "seg", "n", "doc_id", "row", "at", "before", "content"])

    return T.giving_back(run)


Engine = Callable[[list[bytes], np.ndarray, int, bool], list[np.ndarray]]


def _decided(unit: Unit, engine: Engine, keep_first: bool):
    """Runs the engine on whole groups; gives (anchor, seg, spans): windows first..last-1 of each segment that repeat."""

    def settle(rows):
        rows = [row for row, before in zip(rows, [(None, None), *rows], strict=False) if row[:2] != before[:2]]
        anchors, segs, counts, contents = zip(*rows, strict=True)
        flags = engine(list(contents), np.array(counts), unit.window, keep_first)
        spans = [[{"first": x, "last": y} for x, y in zip(*(e.tolist() for e in T.run_bounds(f)), strict=True)] for f in flags]
        return pa.record_batch([pa.array(anchors, pa.int64()), pa.array(segs, pa.int64()), pa.array(spans, _SPAN_TYPE)], names=["anchor", "seg", "spans"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 7)), strict=True):
                if size > ENGINE_BYTES and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield settle(rows)

    return T.giving_back(run)


_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS = "array<struct<first:int,last:int>>"


def _digest(content: bytes, place: int) -> int:
    return int.from_bytes(blake2b(content, digest_size=8, salt=place.to_bytes(8, "little")).digest(), "little", signed=True)


def _parts(unit: Unit, step: int):
    """Parts of segments whose windows hold the anchor at `step` neighbouring places, with what these have in common."""
    names = ["anchor", "seg", "first", "size", "key", "part", "n", "doc_id", "row", "at", "before", "content"]

    def run(batches):
        for batch in batches:
            pick, out = [], []
            for i, (before, content) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)):
                elements, join = (content.split(), b" ".join) if unit.by_word else (content, bytes)
                least = before - (len(elements) - unit.window)
                for nth in range(least // step, before // step + 1):
                    low, high = nth * step, min(nth * step + step - 1, unit.window - unit.gram)
                    key = _digest(join(elements[before - low : before - high + unit.window]), nth)
                    low, high = max(least, low), min(before, high)
                    own = join(elements[before - high : before - low + unit.window])
                    pick.append(i)
                    out.append((before - high, high - low + 1, key, _digest(own, high), high, own))
            first, size, key, part, high, own = zip(*out, strict=True) if out else [()] * 6
            take = lambda c: batch.column(c).take(pa.array(pick, pa.int64()))  # noqa: B023, E731
            number = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch([take(0), take(1), number(first), number(size), number(key), number(part), *(take(c) for c in (2, 3, 4, 5)), number(high), pa.array(own, pa.binary())], names=names)

    return T.giving_back(run)


def _group_spans(segs: DataFrame, unit: Unit, engine: Engine, keep_first: bool, group: int, step: int) -> DataFrame:
    """(anchor, seg, spans) of stored segments (anchor, seg, n, doc_id, row, at, before, content), different in each group."""
    large = segs.groupBy("anchor").agg(F.count("*").alias("members")).where(F.col("members") > group).select("anchor")
    large = materialize(large)
    if large.isEmpty():
        return _engine_spans(segs, unit, engine, keep_first)
    small = _engine_spans(segs.join(small_list(large), "anchor", "left_anti"), unit, engine, keep_first)
    kind = dict(segs.dtypes)["doc_id"]
    schema = f"anchor bigint, seg bigint, first bigint, size bigint, key bigint, part bigint, n bigint, doc_id {kind}, row bigint, at bigint, before bigint, content binary"
    parts = materialize(segs.join(small_list(large), "anchor", "left_semi").mapInArrow(_parts(unit, step), schema))
    order = F.struct("doc_id", "row", "at")
    merged = parts.groupBy("key", "part").agg(F.sum("n").alias("n"), F.min(order).alias("o"), F.first("before").alias("before"), F.first("content").alias("content"))
    merged = materialize(merged.select(F.col("key").alias("anchor"), F.col("part").alias("seg"), "n", "o.*", "before", "content"))
    found = _group_spans(merged, unit, engine, keep_first, group, (step + 1) // 2)
    known = merged.select(F.col("anchor").alias("key"), F.col("seg").alias("part"), F.col("n").alias("total"), order.alias("o"))
    found = found.where("size(spans) > 0").withColumnsRenamed({"anchor": "key", "seg": "part"})
    whole = order > F.col("o") if keep_first else F.col("total") > 1
    back = parts.drop("content", "before").join(known, ["key", "part"]).join(found, ["key", "part"], "left")
    move = lambda x: F.struct((x["first"] + F.col("first")).cast("int").alias("first"), (x["last"] + F.col("first")).cast("int").alias("last"))
    all_of = F.array(F.struct(F.col("first").cast("int").alias("first"), (F.col("first") + F.col("size")).cast("int").alias("last")))
    back = back.withColumn("spans", F.when(whole, all_of).otherwise(F.transform("spans", move))).where("spans is not null")
    return small.union(materialize(back.groupBy("anchor", "seg").agg(F.flatten(F.collect_list("spans")).alias("spans"))))


def _engine_spans(segs: DataFrame, unit: Unit, engine: Engine, keep_first: bool) -> DataFrame:
    dealt = segs.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row", "at", "seg")
    dealt = dealt.select("anchor", "seg", "n", "doc_id", "row", "at", "before", "content")
    return materialize(dealt.mapInArrow(_decided(unit, engine, keep_first), f"anchor bigint, seg bigint, spans {_SPANS}"))


def repeated_segments(docs: DataFrame, unit: Unit, engine: Engine, keep_first: bool, group: int = GROUP) -> DataFrame:
    """(row, wanted): for each row with repeats, its segments' hashes, whether a copy is the first one, and its spans.

    docs: doc_id, row, text.
    """
    kind = dict(docs.dtypes)["doc_id"]
    marks = docs.select("doc_id", "row", "text").mapInArrow(_marks(unit), f"doc_id {kind}, row bigint, anchor bigint, seg bigint, n bigint, at bigint, before bigint, after bigint")
    counted = marks.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("seg").alias("low"), F.max("seg").alias("high"))
    counted = materialize(counted.where("total > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")))
    hits = materialize(marks.join(counted, "anchor"))
    first = F.min(F.struct("doc_id", "row", "at"))
    mixed = hits.where("not alike")
    segs = mixed.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), first.alias("o"), F.first("before").alias("before"), F.first("after").alias("after"))
    segs = materialize(segs.select("anchor", "seg", "n", "o.*", "before", "after"))
    # a segment that occurs more than once repeats as a whole, but is still one that others can repeat
    wanted = segs.groupBy("row").agg(F.collect_list(F.struct("anchor", "seg", "n", "at", "before", "after")).alias("wanted"))
    named = materialize(wanted)
    there = docs.join(small_list(named.select("row")), "row", "left_semi")
    fetched = there.join(named, "row").select("doc_id", "row", "wanted", "text")  # repeated rows give a segment again
    columns = f"anchor bigint, seg bigint, n bigint, doc_id {kind}, row bigint, at bigint, before bigint, content binary"
    contents = fetched.mapInArrow(_contents(unit), columns)
    large = segs.groupBy("anchor").agg(F.count("*").alias("members")).where(F.col("members") > group).select("anchor")
    large = materialize(large)
    if large.isEmpty():
        spans = _engine_spans(contents, unit, engine, keep_first)
    else:
        contents = materialize(contents.dropDuplicates(["anchor", "seg"]))
        spans = _group_spans(contents, unit, engine, keep_first, group, (unit.window - unit.gram + 2) // 2)
    # back to the rows: (seg, whole): all windows of a copy repeat; (seg, spans): those of the first copy, or of all
    firsts = segs.select("anchor", "seg", "n", F.col("row").alias("first_row"))
    one = hits.where("alike").groupBy("anchor", "seg").agg(first.alias("o"), F.sum("n").alias("n")).select("anchor", "seg", "n", F.col("o.row").alias("first_row"))
    none = F.expr(f"cast(array() as {_SPANS})")
    answers = firsts.join(spans, ["anchor", "seg"], "left").withColumn("spans", F.coalesce("spans", none)).unionByName(one.withColumn("spans", none))
    answers = answers.where("n > 1 or size(spans) > 0")
    found = hits.select("row", "anchor", "seg", F.col("n").alias("own")).distinct().join(answers, ["anchor", "seg"])
    if keep_first:
        found = found.withColumn("begins", F.col("row") == F.col("first_row")).where("not begins or own > 1 or size(spans) > 0")
    else:
        found = found.withColumn("begins", F.col("n") == 1)
    return materialize(found.groupBy("row").agg(F.collect_list(F.struct("seg", "begins", "spans")).alias("wanted")))


def removed(unit: Unit, values: np.ndarray, rows: np.ndarray, keys: np.ndarray, begins: np.ndarray, spans: list, owner: np.ndarray) -> np.ndarray:
    """Flags of the elements in repeating windows. keys, begins, spans: the answers, owner: the row of each."""
    s = segments(unit, values, rows)
    flags = np.zeros(len(values), bool)
    if not len(keys) or not len(s.seg):
        return flags
    known = {(r, k): i for i, (r, k) in enumerate(zip(owner.tolist(), keys.tolist(), strict=True))}
    starts, ends, seen = [], [], set()
    for r, k, place, before, after in zip(s.row.tolist(), s.seg.tolist(), s.place.tolist(), s.before.tolist(), s.after.tolist(), strict=True):
        i = known.get((r, k))
        if i is None:
            continue
        if begins[i] and (r, k) not in seen:
            for x in spans[i]:
                starts.append(place - before + x["first"])
                ends.append(place - before + x["last"] - 1 + unit.window)
        else:
            starts.append(place - before)
            ends.append(place + after)
        seen.add((r, k))
    return T.covered(np.array(starts, np.int64), np.array(ends, np.int64), len(values)) if starts else flags


def apply_removal(docs: DataFrame, found: DataFrame, unit: Unit, make: Callable, schema: str, out: list[str]) -> DataFrame:
    """`make` on each batch: (batch, data, bounds, flags, firsts, words) -> arrays named `out`, for all rows of `docs`.

    docs: any columns, `__row` and `text`. Rows without repeats are not shuffled if the list of the others is small.
    """

    def run(batches):
        for batch in batches:
            data, bounds = T.flat(batch.column("text"))
            wanted = batch.column("__wanted")
            sizes = np.diff(np.asarray(wanted.offsets))
            flat = wanted.flatten()
            keys, begins, spans = np.asarray(flat.field("seg")), np.asarray(flat.field("begins").cast("int8")) > 0, flat.field("spans")
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            for a, b in T.chunks(bounds):
                values, rows, firsts, w = unit.elements(data, bounds[a : b + 1])
                x, y = np.searchsorted(owner, [a, b])
                flags = removed(unit, values, rows, keys[x:y], begins[x:y], spans.slice(x, y - x).to_pylist(), owner[x:y] - a) if y > x else np.zeros(len(values), bool)
                yield pa.record_batch(make(batch.slice(a, b - a), values, flags, firsts, w), names=out)

    none = F.expr("cast(array() as array<struct<seg:bigint,begins:boolean,spans:" + _SPANS + ">>)")
    found = found.toDF("__row", "__wanted")
    keys = small_list(found.select("__row"))
    clean = docs.join(keys, "__row", "left_anti").select(*docs.columns, none.alias("__wanted"))
    dirty = docs.join(keys, "__row", "left_semi").join(found, "__row").select(*docs.columns, "__wanted")
    work = T.giving_back(run)
    return clean.mapInArrow(work, schema).union(dirty.mapInArrow(work, schema))
