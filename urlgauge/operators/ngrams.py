"""Character n-gram counts, document frequencies and TF-IDF weights as tables.

These long tables have no size limit: nothing is gathered on the driver.  The
vector form used for training is in :mod:`urlgauge.models.text`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlgauge.functions.text import char_ngrams, gram_source
from urlgauge.session import broadcast_if_small, materialize

#: Bytes of text that a task counts at once (only a single longer text goes beyond it), and rows it passes on at once.
STEP_BYTES = 1 << 20
STEP_ROWS = 1 << 18


def gram_counts(df: DataFrame, key: str, text: str, low: int = 2, high: int = 3) -> DataFrame:
    """``<key>, gram, tf``: how often each gram occurs in each text.

    ``key`` identifies texts, so each text is counted where it is: its grams are those of
    ``char_ngrams``, as numbers that are sorted, a few texts at a time.  Nothing is
    shuffled, and what grows out of a row is passed on as it comes.
    """
    if not 1 <= low <= high:
        raise ValueError(f"bad n-gram range: {low}..{high}")
    texts = df.select(key, gram_source(F.col(text)).alias("_text"))
    fields = [texts.schema.fields[0], T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType())]

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            data, bounds = _bytes(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = max(int(np.searchsorted(bounds, bounds[first] + STEP_BYTES, side="right")) - 1, first + 1)
                own = data[bounds[first] : bounds[last]]
                for rows, starts, ends, tf in _counted(own, bounds[first : last + 1] - bounds[first], low, high):
                    for at in range(0, len(rows), STEP_ROWS):
                        part = slice(at, at + STEP_ROWS)
                        keys = batch.column(0).take(pa.array(rows[part] + first))
                        yield pa.record_batch([keys, _cut(own, starts[part], ends[part]), pa.array(tf[part])], names=[f.name for f in fields])
                first = last

    return texts.mapInArrow(run, T.StructType(fields))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins and the last one ends."""
    _, bounds, data = texts.cast(pa.large_string()).buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _counted(data: np.ndarray, bounds: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each n: row, first byte and end of one occurrence, and count, of each gram of each row."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(heads, bounds)))
    edges = np.append(heads, len(data))
    size = int(points.max(initial=0)) + 1
    code, codes = rows, len(bounds) - 1  # number of the row and characters so far, and how many numbers there may be
    for n in range(1, min(high, len(points)) + 1):
        if codes * size >= 1 << 63:
            code, codes = np.unique(code, return_inverse=True)[1], len(code)
        begins = len(points) - n + 1
        code, codes = code[:begins] * size + points[n - 1 :], codes * size
        if n >= low:
            at = np.flatnonzero(rows[:begins] == rows[n - 1 :])  # the others reach into the next row
            at = at[np.argsort(code[at])]
            new = np.ones(len(at), bool)
            new[1:] = code[at[1:]] != code[at[:-1]]
            first = np.flatnonzero(new)
            places = at[first]
            yield rows[places], edges[places], edges[places + n], np.diff(np.append(first, len(at)))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between these bytes."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    found = data[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(found))


def document_frequency(
    df: DataFrame, text: str, low: int = 2, high: int = 3, min_df: int = 2
) -> DataFrame:
    """``gram, df`` for grams found in at least ``min_df`` texts.

    Grams every text has are combined before the shuffle; the texts themselves do
    not move.
    """
    grams = df.select(F.explode(F.array_distinct(char_ngrams(text, low, high))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)


def idf(df: Column, documents: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((documents + 1) / (df + 1)) + 1


def tfidf_rows(df: DataFrame, key: str, text: str, low: int = 2, high: int = 3, min_df: int = 2) -> DataFrame:
    """``<key>, gram, tf, df, tfidf``: L2-normalised weights, one row per text and gram.

    Document frequencies are counted and stored first, so that their size is
    known; as a rule they can be broadcast. Texts are spread by key before they grow;
    their counted grams, one row each, meet by key once more for the norm of each text.
    """
    documents = F.lit(df.count())
    frequency = materialize(document_frequency(df, text, low, high, min_df))
    counts = gram_counts(df.select(key, text).repartition(key), key, text, low, high)
    matched = counts.join(broadcast_if_small(frequency, "gram"), "gram")
    weighted = matched.withColumn("_w", F.col("tf") * idf(F.col("df"), documents))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "gram", "tf", "df", (F.col("_w") / norm).alias("tfidf"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``<label>, n, weight``: rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))
