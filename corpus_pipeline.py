"""A corpus from raw documents to packed training sequences, one stage per operator.

Each stage is a Spark job over all that its predecessor kept: it is written to the shared folder
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscape.llm.common import stored, table
from callscape.llm.decontaminate import decontaminated
from callscape.llm.jaccard_join import one_of_each
from callscape.llm.line_dedup import line_dedup_filter
from callscape.llm.packing import pack_documents
from callscape.llm.quality_rules import quality_filter

NEAR_PERCENT = 80  # similarity of near duplicates, over shingles of NEAR_WORDS words
NEAR_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted without their hosts' common lines go."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that occurred before, equal or one edit apart, and documents left without words."""
    return line_dedup_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return one_of_each(docs, NEAR_PERCENT, NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage close to a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenised and packed into sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # similarity, edit distance and packing are beyond SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
