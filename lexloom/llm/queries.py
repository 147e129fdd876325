"""The queries of this package, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.byte_bpe import token_digests
from lexloom.llm.collocations import collocations
from lexloom.llm.decontaminate import benchmark_overlap
from lexloom.llm.language_id import identify
from lexloom.llm.license_scan import license_scan
from lexloom.llm.line_dedup import line_dedup
from lexloom.llm.mixing import mix
from lexloom.llm.ngram_join import ngram_join
from lexloom.llm.oracles import OP1, OP3, OP10, OP11
from lexloom.llm.pii import personal_data
from lexloom.llm.quality import quality_rules
from lexloom.llm.secret_scan import secret_scan
from lexloom.llm.token_alignment import alignment_scores
from lexloom.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_before", "lines_gone")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_language, op3_decontamination, op4_secrets, op5_quality, op6_licenses, op7_toxicity, op8_line_dedup, op9_pii, op10_mixing, op11_collocations, op12_alignment, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op3_decontamination": OP3, "op10_mixing": OP10, "op11_collocations": OP11}
