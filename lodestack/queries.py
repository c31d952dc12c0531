"""Queries over the test tables: one for each operator, each a callable of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import models
from lodestack.config import Settings
from lodestack.functions import rules, scoring
from lodestack.functions import text as T
from lodestack.operators import citations as C
from lodestack.operators import context, dense, evaluate, evidence, index, lexical
from lodestack.plans import search as plan
from lodestack.plans.fixtures import view
from lodestack.sources import artifacts as A
from lodestack.sources import chunks
from lodestack.sources import records as R
from lodestack.storage import new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(c, by: str = " "):
    return F.array_join(c, by)


# --- text and query analysis


@query
def tokenize_docs(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


@query
def query_terms(spark, d):
    q = view(spark, d, "probes").unionByName(view(spark, d, "questions").withColumn("question_id", F.col("question_id") + 100))
    return q.select("question_id", joined(T.query_terms("question")).alias("terms"), joined(T.anchor_terms("question")).alias("anchors"), joined(T.focus_terms("question")).alias("focus"))


@query
def alias_terms(spark, d):
    q, focus = view(spark, d, "probes"), T.focus_terms("question")
    return q.select("question_id", joined(T.expand_aliases(T.query_terms("question"))).alias("terms"), F.size(T.entity_groups("question", focus)).cast("long").alias("n_entities"), F.size(T.concept_groups("question")).cast("long").alias("n_concepts"), joined(T.required_phrases("question", focus), ",").alias("phrases"))


@query
def retrieval_query(spark, d):
    return view(spark, d, "probes").select("question_id", T.retrieval_query("question").alias("expanded"))


@query
def norm_title(spark, d):
    return view(spark, d, "papers").select("pmid", T.norm_title("title").alias("norm"), F.size(T.title_tokens("title")).cast("long").alias("n_tokens"))


@query
def phrase_present(spark, d):
    return view(spark, d, "papers").select("pmid", T.phrase_present("abstract", F.lit("Vitamin-D supplementation")).alias("vitamin"), T.phrase_present("title", F.lit("case control")).alias("case_control"), T.overlap_count(T.content_text("title", "abstract"), T.words("risk", "tp53", "metformin", "risk")).cast("long").alias("overlap"))


# --- lexical and dense retrieval, fusion


BUILT: dict[tuple, str] = {}


def stored(spark, d, kind: str, build: Callable[[str], object]) -> str:
    """The folder of an index of this session over the tables in d, built at first use."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in BUILT:
        folder = new_folder(spark, kind)
        build(folder)
        BUILT[key] = folder
    return BUILT[key]


def lexical_index(spark, d, stemmed: bool = False) -> index.Lexical:
    folder = stored(spark, d, f"index-{'stems' if stemmed else 'words'}", lambda to: index.Lexical.build(view(spark, d, "papers"), to, stemmed))
    return index.Lexical.open(spark, folder, stemmed)


def cells(spark, d) -> index.Cells:
    return index.Cells.open(spark, stored(spark, d, "cells", lambda to: index.Cells.build(view(spark, d, "vectors"), to)))


def corpus(spark, d, stemmed: bool = False) -> plan.Corpus:
    return plan.Corpus(view(spark, d, "papers"), view(spark, d, "citations"), view(spark, d, "vectors").select("pmid", "vector"), lexical_index(spark, d, stemmed))


def asked(spark, d) -> DataFrame:
    v = view(spark, d, "vectors").select((F.col("pmid") - 10000000).alias("question_id"), "vector")
    return view(spark, d, "questions").join(v, "question_id", "left")


@query
def term_stats(spark, d):
    return lexical.term_stats(lexical.postings(view(spark, d, "papers"), "pmid", "title", "abstract"))


@query
def doc_stats(spark, d):
    return lexical.doc_stats(view(spark, d, "papers"), "pmid", "title", "abstract")


@query
def bm25_topk(spark, d):
    return lexical_index(spark, d).bm25(plan.question_terms(view(spark, d, "questions"), T.query_terms("question")), 100)


@query
def bm25_strict_topk(spark, d):
    return lexical_index(spark, d).bm25_strict(lexical.strict_groups(view(spark, d, "probes")), 100)


@query
def bm25_stemmed_topk(spark, d):
    """Over the stemmed index, for questions and probes."""
    q = view(spark, d, "questions").unionByName(view(spark, d, "probes").withColumn("question_id", -1 - F.col("question_id")))
    return lexical_index(spark, d, True).bm25(plan.question_terms(q, T.query_terms("question")), 100)


@query
def stemmed_terms(spark, d):
    return lexical_index(spark, d, True).terms


@query
def dense_topk(spark, d):
    return dense.dense(asked(spark, d).select("question_id", "vector"), view(spark, d, "vectors"), 100)


@query
def ivf_topk(spark, d):
    """Over the stored cells, a tenth of them for each query."""
    c = cells(spark, d)
    return c.search(asked(spark, d).select("question_id", "vector"), 10, max(1, len(c.centres) // 10))


@query
def recall_at_k(spark, d):
    v = view(spark, d, "vectors")
    truth = dense.dense(asked(spark, d).select("question_id", "vector"), v, 10)
    return dense.recall(dense.dense(asked(spark, d).select("question_id", "vector"), v.where("pmid % 5 <> 0"), 10), truth)


@query
def ivf_recall(spark, d):
    """Recall of the stored cells against the exact search over all vectors, by the number of cells that a query visits."""
    c = cells(spark, d)
    probes = sorted({max(1, len(c.centres) * share // 100) for share in (2, 5, 10, 20, 40, 70, 100)})
    return dense.recall_sweep(asked(spark, d).select("question_id", "vector"), c.rows, c.centres, 10, probes)


@query
def alignment_stats(spark, d):
    v = view(spark, d, "vectors")
    met = v.alias("a").join(v.alias("b"), F.expr("a.pmid + 1 = b.pmid")).select(dense.cosine(F.col("a.vector"), F.col("b.vector")).alias("c"))
    return met.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.min("c"), 6).alias("min_cosine"), F.count_if(F.col("c") > 0.95).alias("above_95"))


def fused(spark, d, k: int = 60) -> DataFrame:
    c, q = corpus(spark, d), asked(spark, d)
    return plan.fused_lists(c, q, Settings(rrf_k=k))


@query
def rrf_fuse(spark, d):
    return fused(spark, d).select("question_id", "pmid", "fused")


@query
def rel_normalize(spark, d):
    return fused(spark, d).select("question_id", "pmid", "rel")


@query
def candidate_filter(spark, d):
    c, q = corpus(spark, d), asked(spark, d)
    return plan.ranked(c, q, plan.fused_lists(c, q)).select("question_id", "pmid")


@query
def final_rank(spark, d):
    c, q = corpus(spark, d), asked(spark, d)
    return plan.ranked(c, q, plan.fused_lists(c, q)).select("question_id", "pmid", "score", "rank")


@query
def search(spark, d):
    return plan.search(corpus(spark, d, True), asked(spark, d), 10).select("question_id", "pmid", "score", "context_pos", "context_group")


@query
def search_probes(spark, d):
    """Search with expanded questions, as callers do, and the chosen evidence."""
    return chosen(spark, d).select("question_id", "pmid", "evidence_score", "evidence_tier", "selected_pos")


def chosen(spark, d) -> DataFrame:
    v = view(spark, d, "vectors").select((F.col("pmid") - 10000000).alias("question_id"), "vector")
    probes = view(spark, d, "probes")
    expanded = probes.select("question_id", T.retrieval_query("question").alias("question")).join(v, "question_id", "left")
    c = corpus(spark, d, True)
    return plan.select(plan.search(c, expanded, 30).join(probes, "question_id"), c)


def chosen_papers(spark, d) -> DataFrame:
    """The chosen evidence with its papers' columns, written: search runs once, and papers' texts are not shuffled."""
    return written(lexical.small(written(chosen(spark, d), "chosen")).join(view(spark, d, "papers"), "pmid"), "chosen-papers")


# --- scores


def cited_papers(spark, d) -> DataFrame:
    return view(spark, d, "papers").join(view(spark, d, "citations"), "pmid", "left")


@query
def recency_score(spark, d):
    return view(spark, d, "papers").select("pmid", F.round(F.expr(scoring.recency()), 6).alias("recency"))


@query
def citation_rate(spark, d):
    return cited_papers(spark, d).select("pmid", F.round(F.expr(scoring.citation_rate()), 6).alias("rate"))


@query
def impact_score(spark, d):
    return cited_papers(spark, d).select("pmid", F.round(F.expr(scoring.impact()), 6).alias("impact"))


def ruled(spark, d) -> DataFrame:
    """Every paper with two probe questions by its id, as pairs."""
    q = view(spark, d, "probes").select(F.col("question_id").alias("k"), "question")
    p = view(spark, d, "papers").withColumn("k", F.explode(F.array(F.col("pmid") % 11, (F.col("pmid") * 7 + 3) % 11)))
    return p.join(F.broadcast(q), "k").withColumns({"question_id": F.col("k"), "score": (F.col("pmid") % 100) / 100.0, "impact": (F.col("pmid") % 7) / 7.0}).dropDuplicates(["question_id", "pmid"])


def rule_query(name: str, **exprs: str) -> None:
    def run(spark, d):
        return T.with_rule_columns(ruled(spark, d)).select("question_id", "pmid", *[F.expr(e).alias(k) for k, e in exprs.items()])

    QUERIES[name] = run


@query
def evidence_boost(spark, d):
    p = T.with_rule_columns(view(spark, d, "papers")).withColumn("clinical", F.col("pmid") % 2 == 0)
    return p.select("pmid", F.round(F.expr(scoring.boost()), 6).alias("boost"), F.expr(rules.CLINICALISH).alias("clinicalish"))


@query
def infer_intent(spark, d):
    return view(spark, d, "probes").withColumn("q", F.lower("question")).select("question_id", F.expr(rules.INTENT_LIST).alias("intents"), F.expr(rules.ADJUNCTIVE_Q).alias("adjunctive"), F.expr(rules.BEHAVIORAL_Q).alias("behavioral"), F.expr(rules.CLINICAL_Q).alias("clinical"))


rule_query("evidence_tier", tier=rules.TIER, tier_score=rules.TIER_SCORE)
rule_query("intervention_tags", tags=rules.TAG_LIST)
rule_query("endpoint_score", endpoint=f"round({rules.ENDPOINT_SCORE}, 4)", penalties=rules.ENDPOINT_PENALTIES)
rule_query("exposure_score", exposure=f"round({rules.exposure_score()}, 4)", penalties=rules.exposure_penalties())
rule_query("population_score", population=f"round({rules.POPULATION_SCORE}, 4)", penalty=rules.POPULATION_PENALTY)
rule_query("centrality", centrality=rules.CENTRALITY)
rule_query("signals", conflict=rules.CONFLICT, animal=rules.ANIMAL_ONLY, safety=rules.SAFETY, narrow=rules.NARROW, cinv_drug=rules.CINV_PHARM, cinv_other=rules.CINV_NONPHARM)


@query
def score_paper(spark, d):
    return evidence.score_paper(ruled(spark, d)).select("question_id", "pmid", *evidence.SCORES)


#: Papers of one block: candidates of a question come in blocks of ids, so a group does not grow with the table.
SELECTED_FROM, DEDUPED_FROM = 250, 80


def block(papers: int):
    return F.floor(F.col("pmid") / papers).cast("long")


@query
def select_evidence(spark, d):
    """Of all pairs, each question's within each block of papers; question_id is the block's number times 11 plus the question's."""
    pairs = ruled(spark, d).withColumns({"question_id": block(SELECTED_FROM) * 11 + F.col("question_id"), "rank": F.col("pmid")})
    return evidence.select_evidence(pairs)


# --- dedup and context


@query
def exact_title_dedup(spark, d):
    p = view(spark, d, "papers").withColumns({"question_id": F.col("pmid") % 5, "rank": F.col("pmid")})
    return context.exact_title_dedup(p).select("question_id", "pmid")


@query
def title_jaccard_pairs(spark, d):
    return context.title_jaccard_pairs(view(spark, d, "papers"), 0.8)


@query
def title_classes(spark, d):
    return context.title_classes(view(spark, d, "papers"))


@query
def greedy_dedup(spark, d):
    """All papers; a block has no more of them than may be kept, so each one is compared."""
    p = view(spark, d, "papers").withColumns({"question_id": block(DEDUPED_FROM), "rank": F.col("pmid").cast("int"), "clinical": F.lit(True)})
    return context.greedy_dedup(p, top_n=20, keep=["question_id", "pmid"])


@query
def balanced_context(spark, d):
    p = T.with_rule_columns(view(spark, d, "papers")).withColumns({"question_id": F.col("pmid") % 11, "rank": F.col("pmid"), "clinical": F.col("pmid") % 11 < 5})
    return context.balanced_context(p, 10).select("question_id", "pmid", "context_pos", "context_group")


# --- citations


def with_valid(spark, d) -> DataFrame:
    return view(spark, d, "answers").withColumn("valid_ids", F.array(10000000 + F.col("conv_id"), 10000002 + F.col("conv_id")))


@query
def cited_ids(spark, d):
    return view(spark, d, "answers").select("answer_id", joined(C.cited_ids("answer").cast("array<string>"), ",").alias("cited"), joined(C.ids_anywhere("answer").cast("array<string>"), ",").alias("anywhere"))


@query
def unbracketed_ids(spark, d):
    return view(spark, d, "answers").select("answer_id", joined(C.unbracketed_ids("answer").cast("array<string>"), ",").alias("bare"))


@query
def invalid_ids(spark, d):
    return C.citation_status(with_valid(spark, d)).select("answer_id", joined(F.col("invalid_cited").cast("array<string>"), ",").alias("invalid"))


@query
def citation_status(spark, d):
    s = C.citation_status(with_valid(spark, d))
    return s.select("answer_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("cited", "anywhere", "unbracketed", "invalid_cited", "invalid_anywhere")], "format_warning", "validation_warning", "normalization_note")


@query
def normalize_citations(spark, d):
    return C.validate(with_valid(spark, d)).select("answer_id", "answer")


# --- evaluation


@query
def judge_rollup(spark, d):
    return evaluate.judge_rollup(view(spark, d, "judged"))


def runs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two rankings of each of 13 questions' judged papers."""
    j = view(spark, d, "judged")
    old = lexical.top_k(j.withColumn("s", F.pmod(F.col("pmid") * 7919, F.lit(1009)).cast("double")), 10, score="s")
    new = lexical.top_k(j.withColumn("s", F.pmod(F.col("pmid") * 7919, F.lit(1009)).cast("double") + 40.0 * F.col("relevance")), 10, score="s")
    return old, new


@query
def compare_eval(spark, d):
    return evaluate.compare_runs(*runs(spark, d))


@query
def rank_moves(spark, d):
    return evaluate.rank_moves(*runs(spark, d), 3).select("question_id", "pmid", "old_pos", "new_pos", "delta", "nth")


@query
def set_overlap(spark, d):
    old, new = runs(spark, d)
    met = evaluate.paired(old, new).withColumn("side", F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "removed").otherwise("kept"))
    return met.groupBy("side").agg(F.count("*").alias("n"), F.sum("pmid").alias("ids"))


@query
def run_summary(spark, d):
    p = T.with_rule_columns(view(spark, d, "papers")).withColumn("context_group", F.when(F.expr(rules.CLINICALISH), "clinical/review").otherwise("mechanistic/other"))
    return evaluate.run_summary(runs(spark, d)[1].select("question_id", "pmid").join(p, "pmid"))


@query
def answer_flags(spark, d):
    return view(spark, d, "answers").select("answer_id", joined(evaluate.answer_flags("answer"), "; ").alias("flags"))


@query
def compare_answers_agg(spark, d):
    a = with_valid(spark, d)
    return evaluate.compare_answers(a.where("conv_id % 2 = 0"), a.where("conv_id % 2 = 1"))


@query
def citation_audit(spark, d):
    run = runs(spark, d)[1].select("question_id", "pmid", "pos").join(cited_papers(spark, d), "pmid")
    return evaluate.citation_audit(run.withColumn("impact", F.round(F.expr(scoring.impact()), 6)))


REPLIES = ['{"relevance": 2.7}', '{"relevance": "1.0", "evidence_type": "cohort"}', '{"relevance": "5", "evidence_type": "meta analysis"}', '```json\n{"relevance": 2, "answers_question": true, "reason": "x"}\n```', 'Sure: {"relevance": -1, "evidence_type": "Clinical Trial"} done', "no json", '{"relevance": "x", "evidence_type": "poem"}', '{"relevance": 3, "answers_question": false}']


@query
def normalize_judgement(spark, d):
    rows = spark.range(1).select(F.posexplode(T.words(*REPLIES)).alias("reply_id", "reply"))
    return evaluate.normalize_judgement(rows).drop("reply")


# --- records


@query
def upsert_papers(spark, d):
    p = view(spark, d, "papers")
    new = p.where("pmid % 3 = 0").withColumn("title", F.concat(F.lit("new "), "title")).unionByName(p.where("pmid % 50 = 0").withColumns({"pmid": F.col("pmid") + 5000000, "title": F.lit("added")}))
    again = new.where("pmid % 6 = 0").withColumn("title", F.lit("overtaken")).withColumn("turn", F.lit(0))
    return R.upsert(p, again.unionByName(new.withColumn("turn", F.lit(1))), order="turn").select("pmid", "title", "year")


def fetched(spark, d) -> DataFrame:
    return view(spark, d, "papers").where("pmid % 2 = 0").withColumns({"title": F.lit("fetched"), "abstract": F.lit("fetched abstract"), "journal": F.when(F.col("pmid") % 4 == 0, "Fetched Journal").otherwise(""), "year": F.lit(2001), "mesh": F.lit("M"), "pubtypes": F.lit(""), "retracted": F.lit(1)})


@query
def enrich_fill(spark, d):
    return R.enrich(view(spark, d, "papers"), fetched(spark, d)).select("pmid", "title", F.length("abstract").cast("long").alias("n_abstract"), "journal", "year", "mesh", "pubtypes", "retracted")


@query
def missing_metadata(spark, d):
    return R.missing_metadata(view(spark, d, "papers"))


@query
def integrity_report(spark, d):
    return R.integrity_report(view(spark, d, "papers"), view(spark, d, "citations"), view(spark, d, "vectors"))


@query
def chunk_report(spark, d):
    p = view(spark, d, "papers").withColumn("chunk", (F.col("pmid") % 4).cast("int"))
    again = p.where("pmid % 9 = 0").withColumn("chunk", F.lit(4))
    return R.chunk_report(p.unionByName(again))


@query
def coerce_year(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat((F.col("doc_id") + 1700).cast("string"), F.lit("0115"))).when(F.col("doc_id") % 4 == 1, "abcd").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("19"), (F.col("doc_id") % 100).cast("string"))).alias("raw"))
    return raw.select("doc_id", R.coerce_year("raw").alias("year"))


@query
def unique_ids(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 6 == 0, "x1").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("raw"), F.col("event_id").alias("pos"))
    return R.unique_ids(rows, "raw", "pos")


def article_xml(spark, d) -> DataFrame:
    """Every paper as one article element, its whole abstract included."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("pmid").cast("string"), F.lit("</PMID><Article><ArticleTitle>"), esc(F.col("title")),
        F.lit('</ArticleTitle><Abstract><AbstractText Label="AIM">'), esc(F.col("abstract")), F.lit("</AbstractText><AbstractText>End.</AbstractText></Abstract><Journal><Title>"),
        esc(F.col("journal")), F.lit("</Title><JournalIssue><PubDate><Year>"), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")),
        F.lit("</Year></PubDate></JournalIssue></Journal><PublicationTypeList><PublicationType>"), esc(F.col("pubtypes")), F.lit("</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>"),
    )
    return view(spark, d, "papers").select(xml.alias("xml"))


@query
def parse_xml(spark, d):
    return R.parse_articles(article_xml(spark, d), "xml").select("pmid", "title", "journal", "year", "pubtypes", "retracted")


@query
def parse_chunk_json(spark, d):
    p = view(spark, d, "papers").select("pmid", F.to_json(F.struct(F.col("title").alias("t"), F.col("journal").alias("j"), F.concat(F.col("year").cast("string"), F.lit("0101")).alias("d"), F.split("pubtypes", "; ").alias("pt"))).alias("rec"))
    return R.text_records(p, "rec").select("pmid", "title", "journal", "year", "pubtypes")


@query
def answer_pipeline(spark, d):
    """Search, select, answer with the stand-in model, validate."""
    c = chosen_papers(spark, d)
    return C.validate(models.answer(c, view(spark, d, "probes"))).select("question_id", "answer")


# --- artifacts, overlays, chunks


def artifact(spark, d) -> DataFrame:
    """The newer run as one artifact a question."""
    met = runs(spark, d)[1].select("question_id", "pmid", "pos").join(view(spark, d, "papers").select("pmid", "title", "year"), "pmid")
    named = met.withColumns({"question": F.concat(F.lit("Question "), F.col("question_id").cast("string"), F.lit(" of the set")), "score": 1.0 / F.col("pos"), "answer": F.lit("See [10000001].")})
    return A.as_artifact(named)


@query
def artifact_ids(spark, d):
    return A.ids_in_json(artifact(spark, d), "json", "question_id")


@query
def text_ids(spark, d):
    return A.ids_in_text(view(spark, d, "answers"), "answer", "answer_id")


@query
def selected_rows(spark, d):
    """Rows of one artifact by exact, contained, ambiguous and unknown questions, and the ids that they hold."""
    rows = artifact(spark, d).withColumn("json", F.concat(F.lit("["), F.col("json"), F.lit("]")))
    rows = A.rows_of(rows, "json").select(F.col("question_id").cast("int").alias("n"), "row")
    want = spark.sql("SELECT * FROM VALUES (0L, ' QUESTION 1 of the set '), (1L, 'question 12'), (2L, 'question 1'), (3L, 'nothing') AS w(question_id, question)")
    met = A.row_ids(A.select_row(rows, want), "retrieved")
    return met.select("question_id", "status", joined(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size(A.valid_ids()).cast("long").alias("n_valid"))


@query
def load_papers(spark, d):
    """Mentioned ids with their records; where the local one has no title, the fetched one overlays it."""
    ids = table(spark, d, "events").select((10000000 + F.col("user_id")).alias("pmid"), F.col("event_id").alias("pos"))
    local = view(spark, d, "papers").withColumn("title", F.when(F.col("pmid") % 4 == 0, "").otherwise(F.col("title")))
    return A.load_papers(ids, local, fetched(spark, d)).select("pmid", "title", "journal", "year", "pos")


@query
def uncited_ids(spark, d):
    return A.without_citations(view(spark, d, "papers"), view(spark, d, "citations"))


@query
def judge_deltas(spark, d):
    j = view(spark, d, "judged")
    return evaluate.judge_deltas(j, j.withColumn("relevance", F.least(F.lit(3), F.col("relevance") + F.col("pmid") % 3 - 1)), 5)


@query
def flagged_papers(spark, d):
    run = runs(spark, d)[1].select("question_id", "pmid", "pos").join(cited_papers(spark, d), "pmid")
    return evaluate.flagged(run.withColumn("impact", F.round(F.expr(scoring.impact()), 6))).select("question_id", "pmid", "impact", F.col("nth").cast("long").alias("nth"))


@query
def run_means(spark, d):
    j = view(spark, d, "judged").withColumn("side", F.when(F.col("pmid") % 2 == 0, "old").otherwise("new"))
    j = j.withColumns({"relevance": F.col("relevance").cast("double"), "seconds": F.when(F.col("pmid") % 5 > 0, (F.col("pmid") % 1000) / 8.0)})
    return evaluate.run_means(j, ["relevance", "seconds"])


def answer_pair(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each answer, and a later one to the same question."""
    a = view(spark, d, "answers").withColumn("question_id", F.col("answer_id"))
    without = F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("answer", r"\[[^\]]*\]", "")).otherwise(F.col("answer"))
    return a, a.withColumn("answer", F.concat(without, F.lit(" ["), (10000005 + F.col("conv_id")).cast("string"), F.lit("]")))


@query
def cited_sets(spark, d):
    met = evaluate.cited_sets(*answer_pair(spark, d))
    return met.select("question_id", *[joined(F.col(c).cast("array<string>"), ",").alias(c) for c in ("in_both", "in_either", "added", "removed")])


@query
def run_presence(spark, d):
    j = view(spark, d, "judged")
    return evaluate.run_presence(j.where("question_id % 3 <> 0"), j.where("question_id % 3 <> 1"))


@query
def answer_papers(spark, d):
    """Of three papers offered to each answer, those that it cites."""
    a = view(spark, d, "answers").withColumn("question_id", F.col("answer_id"))
    offered = a.select("question_id", F.posexplode(F.array(10000002 + F.col("conv_id"), 10000000 + F.col("conv_id"), F.lit(10000003).cast("long"))).alias("pos", "pmid"))
    return evaluate.cited_papers(a, offered)


@query
def formatted(spark, d):
    n = F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 41 - 20) / 4.0)
    return table(spark, d, "documents").select("doc_id", A.excerpt("text", 60).alias("excerpt"), A.decimals(n, 1).alias("shown"), A.signed(n, "s").alias("delta"))


def chunk_parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors' ids in four chunks, vectors that lack each chunk's last two, and texts of two papers in three."""
    v = view(spark, d, "vectors")
    ids = v.select((F.col("pmid") % 4).cast("int").alias("chunk"), F.floor((F.col("pmid") - 10000000) / 4).alias("pos"), "pmid")
    vectors = ids.join(v, "pmid").where("pmid % 50 < 48").select("chunk", "pos", "vector")
    record = F.to_json(F.struct(F.col("title").alias("t"), F.col("abstract").alias("a"), F.concat(F.col("year").cast("string"), F.lit("0101")).alias("d")))
    texts = view(spark, d, "papers").where("pmid % 3 > 0").select((F.col("pmid") % 4).cast("int").alias("chunk"), "pmid", record.alias("record"))
    return ids, vectors, texts


@query
def load_chunks(spark, d):
    return chunks.load_chunks(*chunk_parts(spark, d)).select("chunk", "pos", "pmid", "title", F.length("abstract").cast("long").alias("n_abstract"), "year", F.size("vector").cast("long").alias("dim"))


@query
def snapshot_report(spark, d):
    """Tables built from chunks, and the checks of what was written."""
    return chunks.build(spark, chunks.load_chunks(*chunk_parts(spark, d)), view(spark, d, "citations"), new_folder(spark, "snapshot"))


# --- models


@query
def text_blocks(spark, d):
    p = view(spark, d, "papers").withColumn("note", F.concat(F.lit(" A note on "), F.col("pmid").cast("string"), F.lit(". ")))
    return p.select("pmid", F.md5(models.paper_block(400)).alias("paper"), F.md5(models.note_block()).alias("noted"), F.md5(models.judge_block()).alias("judged"), models.title_line().alias("line"))


def asked_papers(spark, d) -> DataFrame:
    """The newer run with a question and the papers' columns."""
    q = view(spark, d, "questions").where("question_id < 13")
    return runs(spark, d)[1].select("question_id", "pmid", "pos").join(q, "question_id").join(view(spark, d, "papers"), "pmid")


@query
def paper_notes(spark, d):
    return models.notes(asked_papers(spark, d))


@query
def judged_papers(spark, d):
    return models.judge(asked_papers(spark, d)).select("question_id", "pmid", "relevance", "evidence_type", "error")


@query
def summaries(spark, d):
    return models.summarize(asked_papers(spark, d), least=8)


@query
def encoded_papers(spark, d):
    """Vectors of the papers' texts by the stand-in encoder, as their length and largest component."""
    v = models.encode(view(spark, d, "papers").select("pmid", "title", "abstract"), models.article_text(), lambda: models.hashed_vectors)
    return v.select("pmid", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("square"))


@query
def answer_response(spark, d):
    """What a service returns for the probes."""
    c = chosen_papers(spark, d)
    return models.response(C.validate(models.answer(c, view(spark, d, "probes"))), c)
