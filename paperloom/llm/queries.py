"""The registered queries of the numbered operators: (spark, sf_dir) to rows over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import (
    decontamination, encoding, hard_negatives, html_extraction, jaccard_join, line_dedup, lm_scoring, merkle_manifest, packing,
    quality_rules, substring_dedup, suffix_dedup, url_filters,
)
from paperloom.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and smoothed n-gram scores of every document."""
    return lm_scoring.query(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 400-byte repeats cover, all occurrences."""
    return suffix_dedup.digest(suffix_dedup.find_repeats(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that earlier windows of 20 words cover."""
    return substring_dedup.digest(substring_dedup.find_duplicates(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 1,024 tokens."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under a shingle similarity of 0.75."""
    return jaccard_join.digest(jaccard_join.group_documents(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns and the verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Huffman blocks and read back."""
    return encoding.query(spark, table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filters.digest(url_filters.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, checked against a tampered table."""
    return merkle_manifest.digest(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more, dropped from all."""
    return line_dedup.digest(line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives in the windows of every anchor's positives."""
    return hard_negatives.query(table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_token_output": op8_token_output,
    "op9_html_extraction": op9_html_extraction,
    "op10_url_filters": op10_url_filters,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
