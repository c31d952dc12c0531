"""Stored indexes: postings by term bucket with their statistics, and vectors by cell. Built once, read by questions."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lodestack.config import DEFAULT, Settings
from lodestack.functions import stem
from lodestack.functions import text as T
from lodestack.operators import dense, lexical

#: Parts that postings are stored in, by the hash of their term.
BUCKETS = 64
#: The part with a row for each document, which has no term.
DOCUMENTS = -1


POSTINGS = "term string, id long, tf long, length long, bucket int"
#: Documents of one Arrow batch of the build; stems that a worker remembers; bytes of a Parquet row group of postings.
BATCH, STEMS, ROW_GROUP = 1000, 500_000, 8 << 20
#: Pairs of a document and a question that one task scores, at most, and those that are worth a task of their own.
PAIRS, LEAST_PAIRS = 2_000_000, 500_000


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: int) -> Iterator[None]:
    """The session with these settings (dots as double underscores) for a while."""
    keys = {k.replace("__", "."): str(v) for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted(stemmed: bool):
    """For mapInArrow: batches of (id, t: tokens) to (term, id, tf, length), in the order of terms within a batch, and a
    row without a term for each document. Each distinct word of a batch is stemmed once. A document's postings all come
    from its own row, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}

        def stem_of(word: str) -> str:
            if word not in known:
                if len(known) >= STEMS:
                    known.clear()
                known[word] = stem.stem(word)
            return known[word]

        for b in batches:
            lists, ids = b.column("t"), b.column("id").to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            terms = np.array([stem_of(w) if stemmed else w for w in words.dictionary.to_pylist()], dtype=object)
            terms, number = np.unique(terms, return_inverse=True)
            code = number[words.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
            both, tf = np.unique(code * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
            at, row = np.divmod(both, len(ids))
            term = pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(terms, pa.string())).dictionary_decode()
            named = ["term", "id", "tf", "length"]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.string()), pa.array(ids), pa.array(np.zeros(len(ids), np.int64)), pa.array(sizes)], named)
            yield pa.RecordBatch.from_arrays([term, pa.array(ids[row]), pa.array(tf.astype(np.int64)), pa.array(sizes[row])], named)

    return run


def best_of(of: list[np.ndarray], questions: int, k: int):
    """For mapInArrow: rows (id, no, w) in the order of id to (q, pmid, score), the partition's k best of each question, ties
    to the smaller id. of: the questions that ask for each term. Blocks of whole papers are matrices of their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows kept so far by question, and the score that a further one must reach in each.
        q, pmid, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(questions, -np.inf)
        most = max(1, PAIRS // max(1, questions))

        def add(ids: np.ndarray, no: np.ndarray, w: np.ndarray) -> None:
            nonlocal q, pmid, score
            papers, row = np.unique(ids, return_inverse=True)
            for low in range(0, len(papers), most):
                block = (row >= low) & (row < low + most)
                at, terms, ws = row[block] - low, no[block], w[block]
                order = np.argsort(terms, kind="stable")
                cuts = np.flatnonzero(np.diff(terms[order])) + 1
                sums = np.zeros((min(most, len(papers) - low), questions))
                for part in np.split(order, cuts):
                    sums[np.ix_(at[part], of[terms[part[0]]])] += ws[part, None]
                rounded = np.floor(sums * 1e6 + 0.5)
                p, c = np.nonzero((sums > 0) & (rounded >= floor))
                q, pmid, score = np.concatenate([q, c]), np.concatenate([pmid, papers[low + p]]), np.concatenate([score, sums[p, c]])
                order = np.lexsort((pmid, -np.floor(score * 1e6 + 0.5), q))
                q, pmid, score = q[order], pmid[order], score[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                last = nth == k - 1
                floor[q[last]] = np.floor(score[last] * 1e6 + 0.5)
                q, pmid, score = q[nth < k], pmid[nth < k], score[nth < k]

        waiting: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            ids, no, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            waiting.append((ids, no, w))
            if sum(len(x[0]) for x in waiting) >= PAIRS // 4:
                ids, no, w = (np.concatenate(x) for x in zip(*waiting, strict=True))
                done = np.searchsorted(ids, ids[-1])  # the last paper may go on
                add(ids[:done], no[:done], w[:done])
                waiting = [(ids[done:], no[done:], w[done:])]
        if waiting:
            add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(pmid), pa.array(score)], ["q", "pmid", "score"])

    return run


@dataclass
class Lexical:
    """postings (bucket, term, id, tf, length of the document), documents (id, length), terms (term, df, cf) and size (n,
    avg_length: one row)."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    size: DataFrame
    stemmed: bool

    @staticmethod
    def build(papers: DataFrame, folder: str, stemmed: bool = True) -> Lexical:
        """Writes the index over title and abstract. stemmed: letters of any script without accents, by their Porter
        stems; else runs of ASCII letters and digits as they are.

        Every task writes the postings of its documents, with a file a bucket; only the statistics of terms are shuffled."""
        body = F.concat_ws(" ", T.text_or_empty("title"), T.text_or_empty("abstract"))
        tokens = stem.folded_tokens(body) if stemmed else T.tokens(body)
        rows, spark = papers.select(F.col("pmid").alias("id"), tokens.alias("t")), papers.sparkSession
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH, spark__sql__maxConcurrentOutputFileWriters=4 * BUCKETS):
            stored = rows.mapInArrow(counted(stemmed), "term string, id long, tf long, length long").withColumn("bucket", F.when(F.col("term").isNull(), DOCUMENTS).otherwise(bucket("term")))
            stored.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{folder}/postings")
        written = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
        written.filter(F.col("bucket") == DOCUMENTS).select("id", "length").write.mode("overwrite").parquet(f"{folder}/documents")
        lexical.term_stats(written.filter(F.col("bucket") != DOCUMENTS)).write.mode("overwrite").parquet(f"{folder}/terms")
        spark.read.parquet(f"{folder}/documents").agg(F.count("*").alias("n"), F.avg("length").alias("avg_length")).write.mode("overwrite").parquet(f"{folder}/size")
        return Lexical.open(spark, folder, stemmed)

    @staticmethod
    def open(spark: SparkSession, folder: str, stemmed: bool = True) -> Lexical:
        schemas = {"postings": POSTINGS, "documents": "id long, length long", "terms": "term string, df long, cf long", "size": "n long, avg_length double"}
        held = {t: spark.read.schema(s).parquet(f"{folder}/{t}") for t, s in schemas.items()}
        held["postings"] = held["postings"].filter(F.col("bucket") != DOCUMENTS)
        return Lexical(**held, stemmed=stemmed)

    def asked(self, terms: DataFrame) -> DataFrame:
        """Distinct (question_id, ..., term, bucket) in the form of the index's terms."""
        out = terms.withColumn("term", stem.stems("term")) if self.stemmed else terms
        return lexical.small(out.distinct().withColumn("bucket", bucket("term")))

    def bm25(self, terms: DataFrame, k: int, s: Settings = DEFAULT) -> DataFrame:
        """Top k papers of each question by BM25 over any of its terms: question_id, pmid, score, pos.

        terms: (question_id, term), repeats count once. Only the buckets of the questions' terms are read. Scores are
        rounded to six digits; ties go to the smaller pmid.
        """
        asked = self.asked(terms)
        if asked.limit(lexical.BROADCAST_ROWS + 1).count() > lexical.BROADCAST_ROWS:
            scored = self.weigh(asked, s).groupBy("question_id", "pmid").agg(F.round(F.sum("w"), 6).alias("score"))
            return lexical.top_k(scored, k)
        rows = asked.select("question_id", "term").collect()  # at most BROADCAST_ROWS
        questions, names = list(dict.fromkeys(r.question_id for r in rows)), sorted({r.term for r in rows})
        number, place = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(questions)}
        of: list[list[int]] = [[] for _ in names]
        for r in rows:
            of[number[r.term]].append(place[r.question_id])
        spark = self.postings.sparkSession
        numbered = spark.createDataFrame(list(number.items()), "term string, no int")
        keys = spark.createDataFrame([(i, q) for q, i in place.items()], StructType().add("q", IntegerType()).add("question_id", terms.schema["question_id"].dataType))
        weight = lexical.weighed(self.held(asked, len(questions), numbered).crossJoin(F.broadcast(self.size)), s)
        best = best_of([np.array(sorted(x)) for x in of], len(questions), k)
        found = weight.select("id", "no", "w").sortWithinPartitions("id").mapInArrow(best, "q int, pmid long, score double")
        scored = found.join(F.broadcast(keys), "q").select("question_id", "pmid", F.round("score", 6).alias("score"))
        return lexical.top_k(scored, k)

    def bm25_strict(self, groups: DataFrame, k: int, s: Settings = DEFAULT) -> DataFrame:
        """As :meth:`bm25`, but a paper needs a term of every group of its question. groups: (question_id, group_no,
        term); questions with fewer than two groups give nothing."""
        need = groups.groupBy("question_id").agg(F.count_distinct("group_no").alias("need")).filter("need >= 2")
        met = self.weigh(self.asked(groups.join(F.broadcast(need), "question_id")), s)
        met = met.groupBy("question_id", "pmid").agg(F.round(F.sum("w"), 6).alias("score"), F.size(F.collect_set("group_no")).alias("held"), F.first("need").alias("need"))
        return lexical.top_k(met.filter("held = need").drop("held", "need"), k)

    def weigh(self, asked: DataFrame, s: Settings) -> DataFrame:
        """A row with the weight ``w`` for each of asked and each paper that holds its term. What is then grouped by
        question and paper is not shuffled again."""
        met = self.held(asked, asked.select("question_id").distinct().count()).withColumnRenamed("id", "pmid").join(asked.drop("bucket"), "term")
        return lexical.weighed(met.crossJoin(F.broadcast(self.size)), s)  # one row

    def held(self, asked: DataFrame, questions: int, numbered: DataFrame | None = None) -> DataFrame:
        """Postings (id, tf, length, df) of the asked terms, once for all questions, dealt out by paper to as many tasks
        as the pairs of a paper and a question need. With the term, or its number (term, no) if that is given."""
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        distinct = asked.select("bucket", "term").distinct()
        own = self.terms.join(lexical.small(distinct), "term").select("bucket", "term", "df")
        if numbered is not None:
            own = own.join(F.broadcast(numbered), "term")
        pairs, most = self.size.first().n * questions, int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, -(-pairs // PAIRS), min(most, -(-pairs // LEAST_PAIRS)))
        met = self.postings.filter(F.col("bucket").isin(buckets)).join(lexical.small(own), ["bucket", "term"])
        return met.select("id", "term" if numbered is None else "no", "tf", "length", "df").repartition(tasks, "id")


@dataclass
class Cells:
    """Vectors by the nearest of about sqrt(n) centres: rows (pmid, vector, cell), stored by cell."""

    rows: DataFrame
    centres: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, folder: str) -> Cells:
        """Writes the vectors by cell. Centres are fitted on a bounded sample; every vector gets a cell."""
        sound = vectors.filter("vector is not null").select("pmid", "vector")
        c = dense.centres(sound, dense.root_cells(sound.count()))
        held = dense.with_cells(sound, c).withColumn("cell", F.element_at("cells", 1)).drop("cells")
        held.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/cells")
        spark = vectors.sparkSession
        spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        return Cells.open(spark, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Cells:
        rows = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r.cell)  # at most 4096
        return Cells(spark.read.schema("pmid long, vector array<float>, cell int").parquet(f"{folder}/cells"), np.array([r.centre for r in rows]).reshape(len(rows), -1))

    def search(self, queries: DataFrame, k: int, probes: int = 20) -> DataFrame:
        """Approximate top k over the ``probes`` cells nearest to each query: columns as :func:`dense.dense`."""
        return dense.scan(queries, self.rows, k, self.centres, probes)
