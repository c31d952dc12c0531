"""Shared helpers: durable lineage cuts, skew-safe lookups and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on; so there can be at most HOT_KEYS hot keys.
HOT_KEYS = 500
#: Keys with fewer rows than this never need special care.
HOT_LEAST = 200
#: Counted links that one task joins into components by itself, and nodes that a task remembers otherwise.
ONE_TASK, REMEMBERED = 200_000, 500_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one process
    (tests, a laptop) a temporary folder is chosen, once for each session; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + os.path.join(tempfile.mkdtemp(prefix="lodestack-"), "checkpoints"))
    return sc.getCheckpointDir()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table into the shared folder and read it from there.

    A table rather than DataFrame.checkpoint(): that keeps the old plan's constraints, whose inference grows from
    round to round in a loop, and writes rows uncompressed.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the tables behind frames that checkpoint() returned and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of long texts small, so that a Python worker's memory stays bounded."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def hot_lookup(facts: DataFrame, dims: DataFrame, key: str, weight: str, total: int, small: Column | None = None) -> DataFrame:
    """Left join of facts with dims (one row a key; ``weight``: how many rows facts has of it), safe under skew.

    Keys with more than total / HOT_KEYS rows are at most HOT_KEYS, so their dims rows are broadcast; a fact row
    that found its key there is spread at random over the shuffle, which only the other keys need. The null key
    finds nothing. ``dims`` is read twice: pass a checkpointed or cheap frame. small: a condition on dims rows of which
    500 may be broadcast; needed where their size has no bound.
    """
    limit = max(HOT_LEAST, total // HOT_KEYS)
    is_hot = (F.col(weight) > limit) & (F.lit(True) if small is None else small)
    values = [c for c in dims.columns if c not in (key, weight)]
    hot = dims.filter(is_hot & F.col(key).isNotNull()).select(
        F.col(key), F.struct(*values).alias("_hot")
    )
    cold = dims.filter(~is_hot & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(0).alias("_spread"), F.struct(*values).alias("_cold")
    )
    met = facts.join(F.broadcast(hot), key, "left")
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    met = met.withColumn("_spread", F.when(done, 1 + F.floor(F.rand(7) * 65536).cast("int")).otherwise(0))
    out = met.join(cold, (F.col(key) == F.col("_key")) & (met["_spread"] == cold["_spread"]), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return out.select(*facts.columns, *(found[c].alias(c) for c in values))


class Sets(dict):
    """Disjoint sets of numbers by their parents; a set's root is its smallest number."""

    def root(self, x: int) -> int:
        top = x
        while (up := self.setdefault(top, top)) != top:
            top = up
        while self[x] != top:
            self[x], x = top, self[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart before."""
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)
        return a != b


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of one partition without those that others already imply."""
    sets = Sets()
    for batch in batches:
        if len(sets) > REMEMBERED:
            sets.clear()
        yield batch[[sets.join(a, b) for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True)]]


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all links of the one partition."""
    sets = Sets()
    for batch in batches:
        for a, b in zip(batch.a.tolist(), batch.b.tolist(), strict=True):
            sets.join(a, b)
    nodes = list(sets)
    yield pd.DataFrame({"node": nodes, "root": [sets.root(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the links (a, b), both long: one row (node, root) a node; root is the smallest node.

    Up to ONE_TASK counted links are joined by one task. More are first thinned out within each partition, then joined by
    alternating large-star and small-star rounds (Kiveris et al. 2014), so the rounds grow with the logarithm of the
    largest component. Each round's edges are checkpointed. A star's centre may be hot; see :func:`hot_lookup`.
    """
    def both(e: DataFrame) -> DataFrame:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        return e.select(F.inline(ends))

    def star(e: DataFrame, n: int, out) -> DataFrame:
        low = checkpoint(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n")))
        made = checkpoint(out(hot_lookup(e, low, "u", "_n", n)).filter("a <> b").distinct())
        drop(low)
        return made

    def to_centre(met: DataFrame) -> DataFrame:
        return met.select(F.col("v").alias("a"), F.col("m").alias("b"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = checkpoint(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if e.count() <= ONE_TASK:
        out = checkpoint(e.coalesce(1).mapInPandas(joined, "node long, root long"))
        drop(e)
        return out
    thin = checkpoint(e.mapInPandas(forest, "a long, b long"))
    drop(e)
    e, was = thin, state(thin)
    for _ in range(most_rounds):
        if not was[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = star(both(e), 2 * was[0], lambda met: to_centre(met.filter("v > u")))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))  # a > b in every row
        small = star(down, large.count(), lambda met: to_centre(met).unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        drop(e, large)
        e, now = small, state(small)
        if now == was:
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        was = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def sized_lookup(facts: DataFrame, dims: DataFrame, key: str, weight: str, most_rows: int = 20_000) -> DataFrame:
    """:func:`hot_lookup`, but dims is broadcast whole where it is counted to have at most most_rows rows."""
    n, total = dims.agg(F.count("*"), F.sum(weight)).first()
    if n <= most_rows:
        return facts.join(F.broadcast(dims.drop(weight)), key, "left").select(
            *facts.columns, *[c for c in dims.columns if c not in (key, weight)]
        )
    return hot_lookup(facts, dims, key, weight, total)
