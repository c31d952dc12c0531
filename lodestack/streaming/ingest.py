"""Incremental ingest of paper records with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack import models
from lodestack.sources import chunks, records

#: Versions of the table that stay behind the newest one, for readers that still hold them.
KEPT = 1


def forget(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, encoder: Callable[[], models.Encode] | None = None, limit: int | None = None) -> StreamingQuery:
    """Upsert every new Parquet file of paper records under ``source`` into the Parquet table, one version folder a batch.

    A batch writes ``table/v=<batch>`` from the version before it, so a failed batch can be repeated; older versions than
    the KEPT before it go. Of several rows of an id in one batch the one of the last file and place wins. With an encoder
    only records that have an abstract count, and their vectors are written to ``table/vectors/b=<batch>``. With a limit,
    nothing is taken once the table has so many rows; the batch that reaches it counts whole.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(records.PAPER).parquet(f"{table}/v={number - 1}") if number else spark.createDataFrame([], records.PAPER)
        new = batch if encoder is None else chunks.with_abstract(batch)
        new = new.limit(0) if limit is not None and old.count() >= limit else new
        turn = new.withColumn("_turn", F.monotonically_increasing_id())
        records.upsert(old, turn, order="_turn").write.mode("overwrite").parquet(f"{table}/v={number}")
        if encoder is not None:
            last = new.dropDuplicates(["pmid"]).select("pmid").join(spark.read.schema(records.PAPER).parquet(f"{table}/v={number}"), "pmid")
            models.encode(last, models.article_text(), encoder).select("pmid", "vector").write.mode("overwrite").parquet(f"{table}/vectors/b={number}")
        if number > KEPT:
            forget(spark, f"{table}/v={number - KEPT - 1}")

    stream = spark.readStream.schema(records.PAPER).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
