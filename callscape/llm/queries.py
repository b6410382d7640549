"""Registered queries of the operators: thin callers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscape.llm.common import table
from callscape.llm.conversation_repair import repair_report
from callscape.llm.decontaminate import contamination_report
from callscape.llm.html_crf import main_texts
from callscape.llm.jaccard_join import similar_documents
from callscape.llm.licenses import license_scan
from callscape.llm.line_dedup import line_dedup_report
from callscape.llm.merkle import merkle_report
from callscape.llm.packing import pack_documents
from callscape.llm.quality_net import quality_scores
from callscape.llm.quality_rules import quality_report
from callscape.llm.range_coder import through_files
from callscape.llm.simhash_trie import simhash_duplicates
from callscape.llm.warc import archive_pages


def op1_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op8_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_report(table(spark, sf_dir, "documents"))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_net": op1_quality_net,
    "op2_warc_archive": op2_warc_archive,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_html_main_text": op7_html_main_text,
    "op8_range_coded_ids": op8_range_coded_ids,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_trie": op12_simhash_trie,
    "op13_conversation_repair": op13_conversation_repair,
}
