"""Precomputed chunks (vectors, ids, texts) and the tables that are built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources import records

TABLES = {"papers": records.PAPER, "citations": "pmid long, citation_count int, rcr double", "vectors": "pmid long, vector array<float>"}


def chunk_of(path: Column) -> Column:
    """The number in a file's name, as in ``embeds_chunk_12.npy``."""
    return F.regexp_extract(path, r"_chunk_([0-9]+)\.[a-z]+$", 1).cast("int")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, pos, pmid) of files that are one JSON list of ids (numbers or strings)."""
    raw = spark.read.text(path, wholetext=True).select(chunk_of(F.input_file_name()).alias("chunk"), F.from_json("value", "array<string>").alias("ids"))
    return raw.select("chunk", F.posexplode("ids").alias("pos", "v")).select("chunk", F.col("pos").cast("long").alias("pos"), F.trim("v").cast("long").alias("pmid"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, pos, vector) of .npy files."""
    return records.read_npy(spark, path).select(chunk_of(F.col("path")).alias("chunk"), "pos", "vector")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, pmid, record as JSON) of files that map ids to records or list records. A listed record's id is its pmid,
    else id, else d; of an id that comes again in a chunk the last record counts; what is no record goes."""
    raw = spark.read.text(path, wholetext=True).select(chunk_of(F.input_file_name()).alias("chunk"), F.trim("value").alias("v"))
    mapped = raw.where("startswith(v, '{')").select("chunk", F.posexplode(F.map_entries(F.from_json("v", "map<string,string>"))).alias("n", "e")).select("chunk", "n", F.col("e.key").alias("id"), F.col("e.value").alias("record"))
    part = lambda k: F.nullif(F.nullif(F.get_json_object("r", f"$.{k}"), F.lit("")), F.lit("0"))
    listed = raw.where("startswith(v, '[')").select("chunk", F.posexplode(F.from_json("v", "array<string>")).alias("n", "r")).where("startswith(trim(r), '{')")
    listed = listed.select("chunk", "n", F.coalesce(part("pmid"), part("id"), part("d")).alias("id"), F.col("r").alias("record"))
    both = mapped.unionByName(listed).withColumn("pmid", F.trim("id").try_cast("long")).where("pmid is not null")
    return both.groupBy("chunk", "pmid").agg(F.max_by("record", "n").alias("record"))


def aligned(ids: DataFrame, vectors: DataFrame, most: int | None = None) -> DataFrame:
    """(chunk, pos, pmid, vector): ids and vectors of one position; what one side has more of goes, and beyond ``most``
    rows a chunk everything."""
    out = ids.join(vectors, ["chunk", "pos"])
    return out if most is None else out.where(F.col("pos") < most)


def load_chunks(ids: DataFrame, vectors: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """Paper records with chunk, pos and vector; an id without a text gets blanks."""
    made = records.text_records(texts, "record", keep=["chunk"])
    met = aligned(ids, vectors, most).join(made, ["chunk", "pmid"], "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "abstract", "journal", "mesh", "pubtypes")} | {"retracted": F.coalesce("retracted", F.lit(0))}
    return met.withColumns(blank)


def init_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables where there are none yet; existing ones stay."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def reset(spark: SparkSession, folder: str) -> None:
    """Every table empty."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_vectors(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Appends vectors, or replaces all. Appending does not remove repeats: see :func:`repeated_vectors`."""
    df.select("pmid", "vector").write.mode("overwrite" if overwrite else "append").parquet(f"{folder}/vectors")


def repeated_vectors(vectors: DataFrame) -> DataFrame:
    """Ids with several vectors: pmid, times."""
    return vectors.groupBy("pmid").agg(F.count("*").alias("times")).where("times > 1")


def with_abstract(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """Papers that have an abstract, the first ``limit`` by id if given."""
    out = papers.where(F.length(F.coalesce("abstract", F.lit(""))) > 0)
    return out if limit is None else out.orderBy("pmid").limit(limit)


def build(spark: SparkSession, loaded: DataFrame, citations: DataFrame, folder: str) -> DataFrame:
    """Writes the tables from loaded chunks (of an id in several chunks the last one's record counts) and returns their
    report: the checks of the written tables, and a row ``overall``."""
    columns = records.COLUMNS
    last = loaded.groupBy("pmid").agg(F.max_by(F.struct(*[c for c in columns if c != "pmid"], "vector"), F.struct("chunk", "pos")).alias("r"))
    reset(spark, folder)
    last.select("pmid", *[F.col(f"r.{c}").alias(c) for c in columns if c != "pmid"]).write.mode("overwrite").parquet(f"{folder}/papers")
    write_vectors(last.select("pmid", F.col("r.vector").alias("vector")), folder, overwrite=True)
    citations.select("pmid", "citation_count", "rcr").write.mode("overwrite").parquet(f"{folder}/citations")
    return with_overall(records.integrity_report(*(spark.read.parquet(f"{folder}/{t}") for t in ("papers", "citations", "vectors"))))


def with_overall(report: DataFrame) -> DataFrame:
    """A report (check, value, status) with a row ``overall``: pass if every check passes; value counts those that do not."""
    bad = F.count_if(F.col("status") != "pass")
    whole = report.agg(F.lit("overall").alias("check"), bad.cast("double").alias("value"), F.when(bad == 0, "pass").otherwise("warn").alias("status"))
    return report.unionByName(whole)
