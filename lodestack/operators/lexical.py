"""Postings, statistics and the BM25 weight; :mod:`lodestack.operators.index` stores and searches them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.config import DEFAULT, Settings
from lodestack.functions import lexicon as L
from lodestack.functions import text as T

#: Rows up to which the questions' terms are broadcast; beyond it the join shuffles on the term.
BROADCAST_ROWS = 500_000


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(term, id, tf) of the tokens of the text columns."""
    terms = F.explode(T.tokens(F.concat_ws(" ", *[T.text_or_empty(c) for c in text_cols])))
    return docs.select(F.col(id_col).alias("id"), terms.alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(id, length): tokens of every document, those without any included. No shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.size(T.tokens(F.concat_ws(" ", *[T.text_or_empty(c) for c in text_cols]))).cast("long").alias("length"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top_k(scored: DataFrame, k: int, group: str = "question_id", score: str = "score", tie: str = "pmid") -> DataFrame:
    """The k best rows of each group with their position from 1; Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def weighed(met: DataFrame, s: Settings) -> DataFrame:
    """Adds the BM25 weight ``w`` to rows with tf, df, length, n and avg_length."""
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = F.col("tf") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("length") / F.col("avg_length"))
    return met.withColumn("w", idf * F.col("tf") * (s.bm25_k1 + 1) / norm)


def strict_groups(questions: DataFrame, keywords: Callable[[Column], Column] | None = None) -> DataFrame:
    """(question_id, group_no, term) from the entity and concept groups of each question."""
    focus = T.focus_terms("question") if keywords is None else keywords(F.col("question"))
    entities = F.transform(T.entity_groups("question", focus), lambda g: F.array_distinct(F.transform(g, lambda a: F.regexp_replace(a, "[^a-z0-9]", ""))))
    concepts = F.transform(T.concept_groups("question"), lambda g: T.words(*L.PROGNOSIS_TERMS))
    return questions.select("question_id", F.posexplode(F.concat(entities, concepts)).alias("group_no", "g")).select("question_id", "group_no", F.explode("g").alias("term"))
