"""The corpus operators' queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.decontamination import contamination
from tallyspark.llm.exact_topk import exact_topk
from tallyspark.llm.html_text import html_text
from tallyspark.llm.line_dedup import line_dedup
from tallyspark.llm.mixing import mix
from tallyspark.llm.ngram_join import ngram_join
from tallyspark.llm.oracles import SQL
from tallyspark.llm.secret_scan import secrets
from tallyspark.llm.shared import table
from tallyspark.llm.substring_dedup import passage_pairs
from tallyspark.llm.suffix_dedup import suffix_dedup
from tallyspark.llm.toxicity import toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_pairs(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_benchmark_decontamination, op3_ngram_jaccard_join, op4_substring_dedup, op5_suffix_array_dedup, op6_exact_topk, op7_html_extraction, op8_secret_scan, op9_toxicity, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
