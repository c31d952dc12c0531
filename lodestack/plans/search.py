"""The whole retrieval plan: lists, fusion, filter, score, dedup, balance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.config import DEFAULT, Settings
from lodestack.functions import text as T
from lodestack.operators import context, dense, evidence, fusion, lexical
from lodestack.operators.index import Lexical
from lodestack.storage import new_folder, written

Keywords = Callable[[Column], Column]


@dataclass
class Corpus:
    """Papers, citations, vectors (pmid, vector) and the stored index over the papers' texts."""

    papers: DataFrame
    citations: DataFrame
    vectors: DataFrame
    index: Lexical

    @staticmethod
    def of(papers: DataFrame, citations: DataFrame, vectors: DataFrame, stemmed: bool = False) -> Corpus:
        """With an index built now, in the shared folder; a standing corpus opens the one that it has."""
        return Corpus(papers, citations, vectors, Lexical.build(papers, new_folder(papers.sparkSession, "index"), stemmed))


def question_terms(questions: DataFrame, terms: Column) -> DataFrame:
    return questions.select("question_id", F.explode(terms).alias("term"))


def fused_lists(corpus: Corpus, questions: DataFrame, s: Settings = DEFAULT, keywords: Keywords | None = None) -> DataFrame:
    """Fusion of the dense, any-term, focus-term and (twice) strict lists. questions: question_id, question, vector.

    The any-term and focus-term lists are one BM25 pass whose groups are (question, list). The result is small and is
    written, since ranking reads it more than once.
    """
    focus = T.focus_terms("question") if keywords is None else keywords(F.col("question"))
    key = lambda k: F.struct(F.col("question_id"), F.lit(k).alias("list_id"))
    terms = lambda k, c: questions.select(key(k).alias("question_id"), F.explode(T.expand_aliases(c)).alias("term"))
    lexical_lists = corpus.index.bm25(terms(1, T.query_terms("question")).unionByName(terms(2, focus)), s.lexical_k, s)
    lexical_lists = lexical_lists.select("question_id.question_id", "pmid", "question_id.list_id", "pos", F.lit(1.0).alias("weight"))
    lists = [
        fusion.tagged(dense.dense(questions.select("question_id", "vector"), corpus.vectors, s.dense_k), 0),
        lexical_lists,
        fusion.tagged(corpus.index.bm25_strict(lexical.strict_groups(questions, keywords), s.lexical_k, s), 3, 2.0),
    ]
    return written(fusion.relative(fusion.rrf(fusion.union(*lists), s.rrf_k)), "fused")


#: What ranking hands on; texts are joined again where they are needed.
LIGHT = ["question_id", "pmid", "title", "abstract", "journal", "year", "pubtypes", "clinical", "ev", "rel", "overlap", "focus_overlap", "impact", "boost", "citation_count", "rcr", "score", "first_list", "first_pos"]


def ranked(corpus: Corpus, questions: DataFrame, fused: DataFrame, s: Settings = DEFAULT, keywords: Keywords | None = None) -> DataFrame:
    """Candidates that pass the filter, scored and ranked. Texts join only here, on the few fused ids; of an abstract
    only as much is handed on as tells whether there is one."""
    features = context.features(questions.select("question_id", "question"), keywords)
    found = corpus.papers.join(lexical.small(fused), "pmid")
    met = found.join(features, "question_id").join(corpus.citations, "pmid", "left")
    kept = context.scored(context.candidate_filter(context.measured(met), s), s)
    return fusion.ranked_by(kept.withColumn("abstract", F.substring(F.trim("abstract"), 1, s.min_chars)).select(LIGHT), "score")


def search(corpus: Corpus, questions: DataFrame, top_n: int, s: Settings = DEFAULT, keywords: Keywords | None = None) -> DataFrame:
    """The balanced context of each question. keywords: a column function that gives a question's one or two focus terms
    (a model, see :func:`lodestack.models.keywords`); without it they follow from the words."""
    kept = context.greedy_dedup(ranked(corpus, questions, fused_lists(corpus, questions, s, keywords), s, keywords), s, top_n)
    return context.balanced_context(kept, top_n, "kept_rank", s)


def select(found: DataFrame, corpus: Corpus, s: Settings = DEFAULT) -> DataFrame:
    """The chosen evidence of a search result that has the question's text in ``question``. The result is written, since
    it is counted before it is sent to the papers; their texts are not shuffled."""
    whole = lexical.small(written(found.drop("abstract"), "found")).join(corpus.papers.select("pmid", "abstract"), "pmid")
    return evidence.select_evidence(whole.withColumn("rank", F.col("context_pos")), s)
