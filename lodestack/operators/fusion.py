"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tagged(ranked: DataFrame, list_id: int, weight: float = 1.0) -> DataFrame:
    """A ranked list (question_id, pmid, pos) with its number and weight."""
    return ranked.select("question_id", "pmid", F.lit(list_id).alias("list_id"), F.col("pos").cast("int").alias("pos"), F.lit(float(weight)).alias("weight"))


def union(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """question_id, pmid, fused (sum of weight / (k + pos)) and where it was first seen (first_list, first_pos)."""
    first = F.min(F.struct("list_id", "pos"))
    out = lists.groupBy("question_id", "pmid").agg(F.round(F.sum(F.col("weight") / (k + F.col("pos"))), 9).alias("fused"), first.alias("f"))
    return out.select("question_id", "pmid", "fused", F.col("f.list_id").alias("first_list"), F.col("f.pos").alias("first_pos"))


def relative(fused: DataFrame) -> DataFrame:
    """Adds rel: fused over the question's highest."""
    top = F.max("fused").over(Window.partitionBy("question_id"))
    return fused.withColumn("rel", F.round(F.col("fused") / top, 9))


def ranked_by(df: DataFrame, score: str) -> DataFrame:
    """Adds rank by score, ties in the order of first sight."""
    order = Window.partitionBy("question_id").orderBy(F.desc(score), "first_list", "first_pos")
    return df.withColumn("rank", F.row_number().over(order))
