"""The corpus pipeline: language, near copies, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urlgauge.llm.decontaminate import clean_documents
from urlgauge.llm.language import fit_language, known_language
from urlgauge.llm.near_duplicates import without_near_duplicates
from urlgauge.llm.pieces import encode_pieces
from urlgauge.llm.suffix_dedup import without_repeated_passages
from urlgauge.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded_batches(spark: SparkSession) -> None:
    """Fewer whole texts in an Arrow batch than by default, so that tasks hold little at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go: null and letterless texts, and texts of no known language."""
    bounded_batches(spark)
    return known_language(docs, fit_language(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    bounded_batches(spark)
    return without_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages lose their later copies; the first one stays. Documents stay, with what is left of their text."""
    bounded_batches(spark)
    return without_repeated_passages(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    bounded_batches(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, and whether these decode to the text."""
    bounded_batches(spark)
    return encode_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language identification", in_known_language),
    ("near-duplicate removal", without_near_copies),
    ("repeated-passage removal", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("piece encoding", as_pieces),
]
#: SQL can express neither the learned language model nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs)
    return docs
