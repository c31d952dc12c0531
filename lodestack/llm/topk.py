"""Exact top-k inner-product search with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it; the distances of a pivot are cut into annuli, and
an annulus is held in blocks of bounded size. Of each annulus the least and greatest distance to every pivot are known.
A vector c of it is at least max over pivots p of (lo_p - d(q, p), d(q, p) - hi_p) from a query q (triangle
inequality), and 2 q.c = |q|^2 + |c|^2 - d(q, c)^2; also q.c <= q.p + |q| hi_p for its own pivot. The lower of the two
is the annulus's bound. A query first searches its own block, then the annuli with the best bounds, then in a second
round all that are left whose bound reaches its k-th score so far; the rest cannot hold a better or equal one.

Queries are sent to the blocks in groups of bounded size; the blocks stay where they are. A partition keeps the k best
of each query and hands on only those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint

#: Vectors of the smallest id hashes that pivots and annulus borders are chosen from; every vector is indexed.
SAMPLE = 4096
PIVOTS = 32
RINGS = 8
#: Vectors of a block and queries of a group, about.
BLOCK = 4096
GROUP = 16_384
#: Annuli of the second round.
NEAREST = 16
FOUND = "query_id long, vec_id long, score long"
#: Stands for no id, and a score under every other.
NONE, FAR = np.iinfo(np.int64).max, -(1 << 62)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<long>): each distinct id and vector once; see :func:`top_k` for what takes part."""
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    out = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & sound)
    return out.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct()


@dataclass
class Pivots:
    """Pivot points and, for each, the borders of its annuli."""

    points: np.ndarray
    borders: np.ndarray

    @staticmethod
    def choose(sample: np.ndarray, pivots: int, rings: int, rounds: int = 8) -> Pivots:
        rng = np.random.default_rng(0)
        points = sample[rng.choice(len(sample), min(pivots, len(sample)), replace=False)].astype(float)
        for _ in range(rounds):
            near, _ = nearest(sample, points)
            for k in range(len(points)):
                if (near == k).any():
                    points[k] = sample[near == k].mean(axis=0)
        near, far = nearest(sample, points)
        cuts = np.linspace(0, 1, rings + 1)[1:-1]
        borders = [np.quantile(far[near == k], cuts) if (near == k).any() else np.quantile(far, cuts) for k in range(len(points))]
        return Pivots(points, np.array(borders).reshape(len(points), rings - 1))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell number (pivot and annulus) and distance to the nearest pivot."""
        near, far = nearest(x, self.points)
        return near * (self.borders.shape[1] + 1) + (far[:, None] > self.borders[near]).sum(axis=1), far


def nearest(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, points)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(x)), near]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(square, 0))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)  # every partial sum is a whole number below 2^53
    return q @ c.T


class Best:
    """The k best different (score, then smaller id) of each query so far; scores under ``least`` do not count."""

    def __init__(self, least: np.ndarray, k: int):
        self.k = k
        self.score, self.id = np.repeat(least[:, None] - 1, k, axis=1), np.full((len(least), k), NONE)

    def least(self) -> np.ndarray:
        """The score that counts from now on."""
        return np.where(self.id[:, -1] == NONE, self.score[:, -1] + 1, self.score[:, -1])

    def add(self, of: np.ndarray, own: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """score: a row for each query in ``of`` (of the id in ``own``), a column for each of ids."""
        hit = score >= self.least()[of][:, None]
        for row in np.flatnonzero(hit.any(axis=1)).tolist():
            i, at = of[row], np.flatnonzero(hit[row])
            at = at[ids[at] != own[row]]
            if len(at) > 64 * self.k:
                at = at[np.lexsort((ids[at], -score[row][at]))]
                fresh = np.append(True, (ids[at][1:] != ids[at][:-1]) | (score[row][at][1:] != score[row][at][:-1]))
                at = at[fresh][: self.k]
            both, held = np.concatenate([self.score[i], score[row][at]]), np.concatenate([self.id[i], ids[at]])
            order = np.lexsort((held, -both))
            both, held = both[order], held[order]
            fresh = np.append(True, (held[1:] != held[:-1]) | (both[1:] != both[:-1])) & (held != NONE)
            n = min(self.k, int(fresh.sum()))
            floor = self.score[i, -1]
            self.score[i], self.id[i] = floor, NONE
            self.score[i, :n], self.id[i, :n] = both[fresh][:n], held[fresh][:n]

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        n, at = np.nonzero(self.id != NONE)
        return pd.DataFrame({"query_id": query_ids[n], "vec_id": self.id[n, at], "score": self.score[n, at]}, dtype="int64")


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, dim), dtype=np.int64)


@dataclass
class Annuli:
    """What is known of each annulus: least and greatest distance to every pivot, and the greatest squared norm."""

    cells: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norm: np.ndarray

    def bounds(self, q: np.ndarray, pivots: Pivots) -> np.ndarray:
        """No vector of annulus j scores above [i, j] with query i."""
        q = q.astype(float)
        d, norm = distances(q, pivots.points), (q * q).sum(axis=1)
        gap = np.zeros((len(q), len(self.cells)))
        for p in range(d.shape[1]):
            at = d[:, p : p + 1]
            np.maximum(gap, np.maximum(self.lo[:, p] - at, at - self.hi[:, p]) - 1e-6 * (1 + at), out=gap)
        near = self.cells // (pivots.borders.shape[1] + 1)
        ball = (q @ pivots.points.T)[:, near] + np.sqrt(norm)[:, None] * self.hi[np.arange(len(near)), near]
        out = np.minimum((norm[:, None] + self.norm - gap * gap) / 2, ball)
        return out + 1e-6 * np.abs(out) + 1  # beyond what rounding may have taken


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", visits: Accumulator | None = None) -> DataFrame:
    """The k highest inner products of floor(256 x) for every query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the column ``id``. All rows but those of the query's own id are candidates; ties go
    to the smaller id; fewer candidates give fewer rows. Vectors that are null, empty or hold null or non-finite
    components, and rows of null id, take no part; nor do vectors of another length than the most frequent (ties: the
    longest). A repeated id and vector counts once; an id with several vectors has a score with each. Other columns
    are not read. visits: is increased by every pair of query and vector that is compared.
    """
    spark = df.sparkSession
    every = checkpoint(whole_vectors(df, id_col, vec_col))
    length = every.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, kind = length.n, "<i2" if length.most < 2**15 else "<i4" if length.most < 2**31 else "<i8"
    every = every.filter(F.size("v") == dim)
    sample = every.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    pivots = Pivots.choose(np.array([r.v for r in sample], dtype=np.int64), PIVOTS, RINGS)
    unpacked = lambda b: np.frombuffer(b, dtype=kind).reshape(-1, dim).astype(np.int64)

    @F.pandas_udf("cell int, d array<double>, norm double, m binary")
    def place(vs: pd.Series) -> pd.DataFrame:
        x = matrix(vs, dim)
        return pd.DataFrame({"cell": pivots.cells(x)[0].astype("int32"), "d": list(distances(x, pivots.points)), "norm": (x.astype(float) ** 2).sum(axis=1), "m": [r.tobytes() for r in x.astype(kind)]})

    placed = checkpoint(every.withColumn("p", place("v")).select("id", is_query.alias("asks"), "p.*"))
    ends = [f(F.get("d", F.lit(p))).alias(f"{n}{p}") for n, f in (("lo", F.min), ("hi", F.max)) for p in range(len(pivots.points))]
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *ends).toPandas()  # at most PIVOTS * RINGS rows
    side = lambda n: stats[[f"{n}{p}" for p in range(len(pivots.points))]].to_numpy()
    annuli = Annuli(stats.cell.to_numpy(dtype=np.int64), side("lo"), side("hi"), stats.norm.to_numpy())
    parts = {int(c): -(-int(n) // BLOCK) for c, n in zip(stats.cell, stats.n, strict=True)}
    sub = F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("cell")))
    blocked = placed.withColumn("block", F.col("cell") * F.lit(1 << 32) + sub)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": group.block.iloc[:1], "cell": group.cell.iloc[:1], "ids": [group.id.to_numpy(dtype="<i8").tobytes()], "asks": [group.asks.to_numpy(dtype=bool).tobytes()], "m": [b"".join(group.m)]})

    schema = "block long, cell int, ids binary, asks binary, m binary"
    blocks = checkpoint(blocked.select("block", "cell", "id", F.coalesce("asks", F.lit(False)).alias("asks"), "m").groupBy("block").applyInPandas(pack, schema))

    def own_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, asks, m in zip(b.ids, b.asks, b.m, strict=True):
                ids, x = np.frombuffer(ids, dtype="<i8"), unpacked(m)
                for q in np.array_split(of := np.flatnonzero(np.frombuffer(asks, dtype=bool)), -(-len(of) // 1024) or 1):
                    held = Best(np.full(len(q), FAR), k)
                    held.add(np.arange(len(q)), ids[q], ids, products(x[q], x))
                    if visits is not None:
                        visits.add(len(q) * len(x))
                    yield held.frame(ids[q])

    found = checkpoint(blocks.mapInPandas(own_block, FOUND))
    asked = blocked.filter("asks").select("id", "m", "block")
    groups = max(1, -(-asked.count() // GROUP))
    for g in range(groups):
        of_group = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(groups)) == g
        rows = asked.filter(of_group).collect()  # about GROUP
        if not rows:
            continue
        ids, own = np.array([r.id for r in rows]), np.array([r.block for r in rows])
        q = unpacked(b"".join(r.m for r in rows))
        for round_ in range(2):
            nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            known = found.filter(F.pmod(F.xxhash64(F.lit(5), "query_id"), F.lit(groups)) == g).distinct()
            kth = {r.query_id: r.score for r in known.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") == k).select("query_id", "score").collect()}
            sent = spark.sparkContext.broadcast((ids, own, q, np.array([kth.get(i, FAR) for i in ids.tolist()])))

            def meet(batches: Iterator[pd.DataFrame], sent=sent, round_=round_) -> Iterator[pd.DataFrame]:
                ids, own, q, least = sent.value
                bound, held = annuli.bounds(q, pivots), Best(least, k)
                turn = np.zeros_like(bound, dtype=bool)  # the annuli of this round: the NEAREST best, then the others
                np.put_along_axis(turn, np.argsort(-bound, axis=1, kind="stable")[:, :NEAREST], True, axis=1)
                turn = turn if not round_ else ~turn
                column = {int(c): j for j, c in enumerate(annuli.cells)}
                for b in batches:
                    for block, cell, b_ids, m in zip(b.block, b.cell, b.ids, b.m, strict=True):
                        j = column[int(cell)]
                        of = np.flatnonzero(turn[:, j] & (bound[:, j] >= held.least()) & (own != block))
                        x, x_ids = unpacked(m), np.frombuffer(b_ids, dtype="<i8")
                        if visits is not None:
                            visits.add(len(of) * len(x))
                        for part in np.array_split(of, -(-len(of) // 1024) or 1):
                            if len(part):
                                held.add(part, ids[part], x_ids, products(q[part], x))
                yield held.frame(ids)

            found = checkpoint(found.unionByName(blocks.mapInPandas(meet, FOUND)))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(embeddings: DataFrame) -> DataFrame:
    """The five best of all other rows for each row whose vec_id is divisible by 50."""
    return top_k(embeddings, F.col("id") % 50 == 0, 5)


OP1_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
