"""The pipeline over documents. Each stage works on all that the one before it kept, written as Parquet and read again.

Every stage takes an empty table and tables with further columns, of any name, and hands all columns on; rows
that repeat, and rows with one doc_id, are kept or dropped by their own text but where a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hybridqa.llm.common import discard, materialise, table
from hybridqa.llm.decontaminate import keep_clean
from hybridqa.llm.near_dedup import keep_first
from hybridqa.llm.packing import packed
from hybridqa.llm.pii import key_of, with_surrogates
from hybridqa.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the rules reject go, null and empty texts among them; a row without a doc_id is judged like any other. Without labels the base rules alone decide."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document with the least doc_id of each group stays, with all rows of that doc_id; rows without a doc_id stay; all texts without words are one group."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows into which a benchmark item leaks go. Null and empty texts stay; an empty benchmark removes nothing; null ids don't matter."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: entities in text are replaced and n_chars follows; every row stays, null texts as they are. The key is the session's."""
    return with_surrogates(docs, key_of(spark)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of the remaining documents in sequences of 2048 ids; null and empty texts are the end id alone, repeated rows are packed each, no rows give no pieces."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing),
]
#: Trees, sketches and tokenizers are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
            if last is not None:
                discard(last)
            last = docs
    return docs
