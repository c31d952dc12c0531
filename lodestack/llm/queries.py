"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe, decontam, licenses, masked_lm, mixing, quality, revisits, simhash, topk, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op1(table(spark, sf_dir, "embeddings"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.op2(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.op4(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op6(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op7(table(spark, sf_dir, "documents"))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.op9(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_top_k, op2_revisits, op3_decontaminate, op4_line_dedup, op5_quality, op6_licenses, op7_token_counts, op8_pareto_mix, op9_masked_lm, op10_simhash)
}
SQL: dict[str, str] = {"op1_top_k": topk.OP1_SQL, "op2_revisits": revisits.OP2_SQL, "op4_line_dedup": winnow.OP4_SQL, "op8_pareto_mix": mixing.OP8_SQL}
