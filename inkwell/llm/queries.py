"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, line_rules, minhash_dedup, mixing, quality_fm, secret_scan, substring_dedup, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that go, each with the one that stays for it."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_fm.train(docs, _table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).filter(f"quality_score >= {quality_fm.CUTOFF}")


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it leaks."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with their evidence."""
    return toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_minhash_dedup, op4_secret_scan, op5_html_extraction, op6_quality_classifier, op7_line_frequency, op8_decontamination, op9_toxicity, op10_source_mixing)
}

#: Queries that SQL can express; the rest have brute-force tests in tests/llm.
ORACLES = {"op7_line_frequency": line_rules.ORACLE}
