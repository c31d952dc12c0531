"""Dense retrieval: exact blocks of matrix products, and cells round k-means centres."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.lexical import top_k

#: Queries sent to the executors at once; more take one pass a block.
QUERY_BLOCK = 4096
#: Vectors that cell centres are fitted on, those of the smallest id hash; every vector gets a cell.
SAMPLE = 20_000


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def stacked(values, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in values]) if len(values) else np.zeros((0, dim))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of QUERY_BLOCK queries at a time, which is what the driver holds of them."""
    ids, vectors = [], []
    for r in queries.filter("vector is not null").select("question_id", "vector").toLocalIterator():
        ids.append(r.question_id)
        vectors.append(r.vector)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), unit(stacked(vectors, 0))
            ids, vectors = [], []
    if ids:
        yield np.array(ids), unit(stacked(vectors, 0))


class Best:
    """The k best (score, then smaller id) of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.pmid = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, of: np.ndarray, pmid: np.ndarray, score: np.ndarray) -> None:
        """score: a row for each query in ``of``, a column for each pmid."""
        for i, s in zip(of.tolist(), score, strict=True):
            at = np.flatnonzero(s >= self.score[i, -1])
            if len(at) > 2 * self.k:
                at = at[s[at] >= np.partition(s[at], len(at) - self.k)[len(at) - self.k]]
            if len(at):
                both, ids = np.concatenate([self.score[i], s[at]]), np.concatenate([self.pmid[i], pmid[at]])
                near = np.lexsort((ids, -both))[: self.k]
                self.score[i], self.pmid[i] = both[near], ids[near]

    def frame(self, question_ids: np.ndarray) -> pd.DataFrame:
        n, at = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"question_id": question_ids[n], "pmid": self.pmid[n, at], "score": self.score[n, at]})


def scan(queries: DataFrame, vectors: DataFrame, k: int, c: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """Top k of each query over vectors (pmid, vector); with centres ``c`` over those (pmid, vector, cell) in the query's
    ``probes`` nearest cells, and only the cells asked for are read. One pass over the vectors for each QUERY_BLOCK
    queries; every partition hands on its k best of a query."""
    out = None
    for ids, q in query_blocks(queries):
        cells = None
        rows = vectors.filter("vector is not null")
        if c is not None:
            near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
            cells = {int(x): np.flatnonzero((near == x).any(axis=1)) for x in np.unique(near)}
            rows = rows.filter(F.col("cell").isin(list(cells)))
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q, cells))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q, cells = sent.value
            held = Best(len(ids), k)
            for b in batches:
                for x, g in b.groupby("cell") if cells is not None else [(None, b)]:
                    of = np.arange(len(ids)) if cells is None else cells[int(x)]
                    held.add(of, g.pmid.to_numpy(), np.round(q[of] @ unit(stacked(g.vector, q.shape[1])).T, 6))
            yield held.frame(ids)

        part = rows.select("pmid", "vector", *(["cell"] if c is not None else [])).mapInPandas(best, "question_id long, pmid long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "question_id long, pmid long, score double, pos int")
    return top_k(out, k)


def dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of highest cosine for each query: question_id, pmid, score, pos.

    queries: (question_id, vector); vectors: (pmid, vector). Null vectors take no part. Scores are rounded to six digits;
    ties go to the smaller pmid.
    """
    return scan(queries, vectors, k)


def centres(vectors: DataFrame, cells: int, rounds: int = 10) -> np.ndarray:
    rows = vectors.filter("vector is not null").orderBy(F.xxhash64("pmid"), "pmid").limit(SAMPLE).select("vector").collect()
    x = unit(stacked([r.vector for r in rows], 1))
    if not len(x):
        return x
    c = x[np.random.default_rng(0).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))]))
    return c


def with_cells(df: DataFrame, c: np.ndarray, probes: int = 1) -> DataFrame:
    """df plus ``cells``: the nearest centres of its vector, best first."""
    sent = df.sparkSession.sparkContext.broadcast(c)

    @F.pandas_udf("array<int>")
    def nearest(vs: pd.Series) -> pd.Series:
        score = unit(stacked(vs, sent.value.shape[1])) @ sent.value.T
        return pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :probes].astype("int32")))

    return df.withColumn("cells", nearest("vector"))


def root_cells(n: int) -> int:
    """About the square root of the number of vectors."""
    return min(4096, max(1, math.isqrt(n)))


def ivf(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int = 4) -> DataFrame:
    """Approximate top k without a stored index: only vectors in the query's nearest cells are compared. Columns as
    :func:`dense`."""
    sound = vectors.filter("vector is not null")
    c = centres(vectors, cells or root_cells(sound.count()))
    return scan(queries, with_cells(sound, c).withColumn("cell", F.element_at("cells", 1)), k, c, probes)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean share of each question's true pmids that were found."""
    hit = truth.select("question_id", "pmid").join(found.select("question_id", "pmid", F.lit(1).alias("hit")), ["question_id", "pmid"], "left")
    per = hit.groupBy("question_id").agg((F.count("hit") / F.count("*")).alias("r"))
    return per.agg(F.count("*").alias("n_questions"), F.round(F.avg("r"), 6).alias("recall"))


def recall_sweep(queries: DataFrame, held: DataFrame, c: np.ndarray, k: int, probes: list[int]) -> DataFrame:
    """Recall against the exact search for each number of probes: probes, n_questions, recall. held: (pmid, vector, cell)."""
    truth, out = scan(queries, held, k), None
    for n in probes:
        row = recall(scan(queries, held, k, c, n), truth).select(F.lit(n).alias("probes"), "n_questions", "recall")
        out = row if out is None else out.unionByName(row)
    return out
