"""A training corpus from raw documents: quality, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and all documents that the stage before it kept; run() writes each result as
Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import common, decontam, mixing, quality, simhash, winnow

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model (learnt from labels outside the held-out third) does not reject. Null and empty
    texts are scored as one empty line; rows of equal text score alike and stay or go together; no rows give none."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs.select(COLUMNS), model, out="quality_score").filter("quality_score >= 0.5").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their later repeated runs of lines; documents of which nothing is left go. n_chars is renewed
    where lines went. Null and empty texts have no lines and stay; rows of one id and text count as one and stay alike; of
    different documents the smaller id keeps a line (see :func:`winnow.dedup_lines`)."""
    out = winnow.dedup_lines(docs.select(COLUMNS))
    blank = F.regexp_count("text", F.lit(mixing.WORD)) == 0
    out = out.filter((F.col("n_deleted") == 0) | ~blank)
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (Jaccard similarity of 0.8 or more on five-word shingles): the smallest id.
    Texts are compared within the SimHash classes of op10's method, then within MinHash bands for what these leave. Null, empty and wordless texts are one group; repeated rows become one (see :func:`simhash.representatives`)."""
    return simhash.representatives(docs.select(COLUMNS), words=5)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together."""
    return decontam.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with size, source_size, target, copies and taken. Documents without words
    stay where whole copies of their source are taken; of equal rows as many stay as fit (see :func:`mixing.mix`)."""
    return mixing.mix(docs.select(COLUMNS)).filter("copies > 0")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: SQL cannot express the trained quality model, the banded alignments or XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
