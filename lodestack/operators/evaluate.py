"""Comparison of runs, judgements, answers and citation audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import lexicon as L
from lodestack.functions.text import any_of, text_or_empty
from lodestack.operators import citations as C


def judge_rollup(judged: DataFrame, group: str = "question_id") -> DataFrame:
    n = F.col("relevance")
    return judged.groupBy(group).agg(F.round(F.avg(n), 3).alias("mean_relevance"), F.count_if(n >= 3).alias("at_3"), F.count_if(n >= 2).alias("at_2"), F.count_if(n == 0).alias("irrelevant"), F.count(n).alias("judged"))


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full join of two runs (question_id, pmid, pos) with old_pos and new_pos."""
    side = lambda df, k: df.select("question_id", "pmid", F.col("pos").alias(f"{k}_pos"))
    return side(old, "old").join(side(new, "new"), ["question_id", "pmid"], "full")


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each question: overlap, union, added, removed and the Jaccard similarity of the two result sets."""
    both = F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()
    out = paired(old, new).groupBy("question_id").agg(F.count_if(both).alias("overlap"), F.count("*").alias("in_either"), F.count_if(F.col("old_pos").isNull()).alias("added"), F.count_if(F.col("new_pos").isNull()).alias("removed"))
    return out.withColumn("jaccard", F.round(F.col("overlap") / F.col("in_either"), 6))


def rank_moves(old: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """The papers of each question that moved furthest: delta = old - new position."""
    met = paired(old, new).filter("old_pos is not null and new_pos is not null").withColumn("delta", F.col("old_pos") - F.col("new_pos")).filter("delta <> 0")
    order = Window.partitionBy("question_id").orderBy(F.desc(F.abs("delta")), F.desc("delta"), F.desc("pmid"))
    return met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)


def only_in(a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def run_summary(run: DataFrame) -> DataFrame:
    """Per question of a run with papers' columns: results, journals, years and context groups."""
    year = F.when(F.col("year") != 0, F.col("year"))
    return run.groupBy("question_id").agg(F.count("*").alias("n_results"), F.count_distinct(F.nullif("journal", F.lit(""))).alias("n_journals"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(F.col("context_group") == "clinical/review").alias("clinical_review"), F.count_if(F.col("context_group") == "mechanistic/other").alias("mechanistic_other"))


def heading_names(answer: Column | str) -> Column:
    """Lower-case names of markdown headings and of lines that are just ``Name:``."""
    found = F.regexp_extract_all(text_or_empty(answer), F.lit(r"(?m)^(?:#{1,6}[ \t]+[^\n]+|[A-Z][A-Za-z \t]+:[ \t]*)$"), 0)
    return F.transform(found, lambda h: F.lower(F.trim(F.regexp_replace(F.regexp_replace(h, r"^#+|:[ \t]*$", ""), r"\s+", " "))))


def section(answer: Column | str, heading: str) -> Column:
    """Text under a ``## heading``, up to the next one; empty without it."""
    return F.trim(F.regexp_extract(text_or_empty(answer), rf"(?is)(?:^|\n)##[ \t]+{heading}[ \t]*(?:\n|$)(.*?)(?=\n##[ \t]|$)", 1))


def answer_flags(answer: Column | str) -> Column:
    """Review flags of an answer, in a fixed order."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text_or_empty(answer)), "\n", " "), F.lit(" "))
    yes = F.startswith(F.lower(section(answer, "Short answer")), F.lit("yes")) & F.contains(low, F.lit("observ"))
    flags = [F.when(yes, "short-answer starts with yes despite observational language")]
    flags += [F.when(F.contains(low, F.lit(f" {w} ")), f"causal term:{w}") for w in L.CAUSAL]
    flags += [F.when(~any_of(low, L.QUALIFYING), "no obvious evidence qualifier"), F.when(~F.array_contains(heading_names(answer), "evidence basis"), "missing Evidence basis section")]
    return F.array_compact(F.array(*flags))


METRICS = ["validation_or_format_warnings", "invalid_cited", "invalid_anywhere", "unbracketed", "normalization_notes", "with_evidence_basis", "with_review_flags"]


def answer_metrics(answers: DataFrame) -> DataFrame:
    """One row (metric, value) for each of METRICS over a run's answers (answer, valid_ids)."""
    a = C.citation_status(answers)
    some = lambda c: F.size(c) > 0
    flags = [F.col("format_warning") | F.col("validation_warning"), some("invalid_cited"), some("invalid_anywhere"), some("unbracketed"), F.col("normalization_note"), F.array_contains(heading_names("answer"), "evidence basis"), some(answer_flags("answer"))]
    one = a.agg(*[F.count_if(c).alias(m) for m, c in zip(METRICS, flags, strict=True)])
    return one.unpivot([], METRICS, "metric", "value")


def compare_answers(old: DataFrame, new: DataFrame) -> DataFrame:
    o, n = answer_metrics(old).withColumnRenamed("value", "old_value"), answer_metrics(new).withColumnRenamed("value", "new_value")
    return o.join(n, "metric").withColumn("delta", F.col("new_value") - F.col("old_value"))


def citation_audit(run: DataFrame, low_citations: int = 10, low_score: float = 0.35) -> DataFrame:
    """Per question: median impact, best paper, and how many papers are little cited or of low impact."""
    c = F.coalesce("citation_count", F.lit(0))
    best = F.max_by("pmid", F.struct(F.col("impact"), -F.col("pos")))
    return run.groupBy("question_id").agg(F.count("*").alias("papers"), F.round(F.median("impact"), 6).alias("median_impact"), F.median(F.col("citation_count").cast("double")).alias("median_citations"), best.alias("best_pmid"), F.count_if(c < low_citations).alias("low_cited"), F.count_if(F.col("impact") < low_score).alias("low_impact"))


def extract_json(text: Column | str) -> Column:
    """The JSON object of a model's reply: without a code fence, from the first brace to the last."""
    return F.nullif(F.regexp_extract(text_or_empty(text), r"(?s)(\{.*\})", 1), F.lit(""))


def normalize_judgement(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Adds relevance (0..3), evidence_type, answers_question, population_or_model and reason from a reply's JSON."""
    j = F.from_json(extract_json(text), "relevance string, evidence_type string, answers_question boolean, population_or_model string, reason string")
    out = replies.withColumn("_j", j)
    number = F.trim("_j.relevance").try_cast("double")
    rel = F.greatest(F.lit(0), F.least(F.lit(3), number.cast("int")))  # towards zero
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce("_j.evidence_type", F.lit("other")))), " ", "_")
    for name, other in L.EVIDENCE_ALIASES.items():
        kind = F.when(kind == name, other).otherwise(kind)
    out = out.withColumn("relevance", F.when(number.isNotNull() & ~F.isnan(number), rel)).withColumn("evidence_type", F.when(kind.isin(L.EVIDENCE_TYPES), kind).otherwise("other"))
    answers = F.when(F.col("relevance") < 3, False).when(F.col("relevance") == 3, F.coalesce("_j.answers_question", F.lit(True))).otherwise(F.coalesce("_j.answers_question", F.lit(False)))
    return out.withColumns({"answers_question": answers, "population_or_model": text_or_empty("_j.population_or_model"), "reason": text_or_empty("_j.reason")}).drop("_j")


def judge_deltas(old: DataFrame, new: DataFrame, top: int) -> DataFrame:
    """The papers of each question that both runs judged differently, the largest change first: question_id, pmid,
    old_relevance, new_relevance, delta, nth. Runs: question_id, pmid, relevance."""
    side = lambda df, k: df.select("question_id", "pmid", F.col("relevance").cast("double").alias(f"{k}_relevance"))
    met = side(old, "old").join(side(new, "new"), ["question_id", "pmid"]).withColumn("delta", F.col("new_relevance") - F.col("old_relevance")).filter("delta <> 0")
    order = Window.partitionBy("question_id").orderBy(F.desc(F.abs("delta")), F.desc("delta"), F.desc("pmid"))
    return met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)


def flagged(run: DataFrame, low_citations: int = 10, low_score: float = 0.35) -> DataFrame:
    """The papers of each question that are little cited or of low impact, the lowest impact first: run's columns, nth."""
    low = (F.coalesce("citation_count", F.lit(0)) < low_citations) | (F.col("impact") < low_score)
    order = Window.partitionBy("question_id").orderBy("impact", "pos")
    return run.where(low).withColumn("nth", F.row_number().over(order))


def run_means(runs: DataFrame, columns: list[str], side: str = "side") -> DataFrame:
    """Old and new mean of numeric columns, nulls left out, and their difference: metric, old_mean, new_mean, delta."""
    mean = lambda c, k: F.avg(F.when(F.col(side) == k, F.col(c)))
    one = runs.agg(*[F.array(mean(c, "old"), mean(c, "new")).alias(c) for c in columns]).unpivot([], columns, "metric", "m")
    old, new = F.col("m")[0], F.col("m")[1]
    return one.select("metric", F.round(old, 6).alias("old_mean"), F.round(new, 6).alias("new_mean"), F.round(new - old, 6).alias("delta"))


def cited_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of each question that both runs answered: what the answers cite (question_id, old_cited, new_cited, in_both,
    in_either, added, removed), as sorted ids."""
    side = lambda df, k: df.select("question_id", C.cited_ids("answer").alias(f"{k}_cited"))
    met = side(old, "old").join(side(new, "new"), "question_id")
    o, n = F.col("old_cited"), F.col("new_cited")
    ids = {"in_both": F.array_intersect(o, n), "in_either": F.array_union(o, n), "added": F.array_except(n, o), "removed": F.array_except(o, n)}
    return met.withColumns({k: F.array_sort(v) for k, v in ids.items()})


def run_presence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every question of either run and whose it is: question_id, side (both, old, new)."""
    ids = lambda df, k: df.select("question_id").distinct().withColumn(k, F.lit(True))
    met = ids(old, "o").join(ids(new, "n"), "question_id", "full")
    return met.select("question_id", F.when(F.col("n").isNull(), "old").when(F.col("o").isNull(), "new").otherwise("both").alias("side"))


def cited_papers(answers: DataFrame, papers: DataFrame) -> DataFrame:
    """The papers (question_id, pmid, pos) that their question's answer cites, in their order."""
    cited = answers.select("question_id", F.explode(C.cited_ids("answer")).alias("pmid"))
    return papers.join(cited, ["question_id", "pmid"], "left_semi")
