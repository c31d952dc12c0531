"""Pluggable encoders and language models; the defaults are deterministic stand-ins that need no weights.

A model is a function of a list. It is called on the executors with one batch at a time; what a factory loads is loaded
once a worker. Prompts are column expressions, so they can be read and tested without a model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import text_or_empty
from lodestack.operators import citations as C
from lodestack.operators import evaluate

Generate = Callable[[list[str]], list[str]]
Encode = Callable[[list[str]], np.ndarray]
#: What stands where a text was cut, and the characters that prompts and the judge read of an abstract.
CUT, PROMPT_CHARS, JUDGE_CHARS = "...[truncated]", 5000, 6000
#: From this many papers on a summary is made of notes.
MAP_REDUCE = 12


def first_ids(prompts: list[str]) -> list[str]:
    """A stand-in model: names the papers of the prompt as its evidence."""
    out = []
    for p in prompts:
        ids = re.findall(r"^\[([0-9]+)\]", p, re.M)
        out.append("## Short answer\nSee " + ", ".join(f"[{i}]" for i in ids[:3]) + ".\n## Evidence basis\nRetrieved papers were associated with the question.")
    return out


def title_note(prompts: list[str]) -> list[str]:
    """A stand-in for notes: the title of the prompt's paper and its id."""
    found = [(re.search(r"^\[([0-9]+)\]", p, re.M), re.search(r"^Title: (.*)$", p, re.M)) for p in prompts]
    return [f"{t[1] if t else ''} [{i[1]}]" if i else "" for i, t in found]


def overlap_judge(prompts: list[str]) -> list[str]:
    """A stand-in judge: relevance by how many of the question's longer words the paper has."""
    out = []
    for p in prompts:
        question, paper = p.partition("\n\n")[0], p.partition("\nPMID: ")[2]
        asked = {w for w in re.findall(r"[a-z0-9]+", question.lower()) if len(w) > 4} - {"question"}
        held = sum(w in paper.lower() for w in asked)
        out.append(f'{{"relevance": {min(3, held)}, "evidence_type": "other", "reason": "{held} of {len(asked)} words"}}')
    return out


def hashed_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """A stand-in encoder: signed counts of the hashes of words."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in re.findall(r"[a-z0-9]+", t.lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little")
            out[i, h % dim] += 1 if h & 1 << 20 else -1
    return out


def generated(prompt: Column, generate: Generate) -> Column:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(generate(prompts.tolist()), dtype=object)

    return run(prompt)


def encode(df: DataFrame, text: Column, factory: Callable[[], Encode], out: str = "vector", size: int = 64) -> DataFrame:
    """df plus the unit vector of a text. factory makes the encoder, once a worker; it gets ``size`` texts at a time. A
    null text counts as empty; a zero vector stays zero."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            texts = b.fillna("").tolist()
            made = [np.asarray(model(texts[i : i + size]), dtype=float) for i in range(0, len(texts), size)]
            m = np.concatenate(made) if made else np.zeros((0, 1))
            yield pd.Series(list((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype("float32")))

    return df.withColumn(out, run(text))


def article_text() -> Column:
    """What an article is encoded from: title and abstract."""
    return F.trim(F.concat_ws(" ", text_or_empty("title"), text_or_empty("abstract")))


def keywords(generate: Generate) -> Callable[[Column], Column]:
    """Focus terms by a model, for :func:`lodestack.plans.search.search`: its reply's comma-separated terms of letters,
    digits, spaces and hyphens with 2 to 40 characters, the first two, those that look like a disease first; where the
    model gives none, those of the words of the question."""
    from lodestack.functions import text as T

    disease = r"(?:itis|osis|emia|oma|pathy|cancer|disease|syndrome|diabetes|failure)\b"

    def terms(question: Column) -> Column:
        reply = F.split(F.lower(text_or_empty(generated(text_or_empty(question), generate))), r"[,;\n]")
        clean = F.transform(reply, lambda t: F.trim(F.regexp_replace(t, r"[^a-z0-9\- ]", "")))
        sound = F.array_distinct(F.filter(clean, lambda t: F.length(t).between(2, 40)))
        first = F.concat(F.filter(sound, lambda t: t.rlike(disease)), F.filter(sound, lambda t: ~t.rlike(disease)))
        return F.when(F.size(sound) > 0, F.slice(first, 1, 2)).otherwise(T.focus_terms(question))

    return terms


def cut(c: Column | str, chars: int) -> Column:
    text = text_or_empty(c)
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(CUT))).otherwise(text)


# Fixed formats: the text blocks of a paper, which prompts and readers of answers rely on.
def paper_head() -> Column:
    """Id, year, journal, publication types and title, as every text block of a paper begins."""
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("?"))
    return F.concat(F.lit("["), F.col("pmid").cast("string"), F.lit("] ("), year, F.lit(", "), text_or_empty("journal"), F.lit("; types="), text_or_empty("pubtypes"), F.lit(")\nTitle: "), text_or_empty("title"))


def paper_block(chars: int = PROMPT_CHARS) -> Column:
    """A paper with its abstract, cut at ``chars`` characters."""
    return F.concat(paper_head(), F.lit("\nAbstract: "), cut("abstract", chars))


def note_block(note: str = "note") -> Column:
    """A paper with its note in place of the abstract."""
    return F.concat(paper_head(), F.lit("\nEvidence note: "), F.trim(text_or_empty(note)))


def judge_block() -> Column:
    """A paper as the judge reads it, one field a line."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    fields = [line("PMID", "pmid"), line("Title", "title"), line("Year", "year"), line("Journal", "journal"), line("Publication types", "pubtypes")]
    return F.concat_ws("\n", *fields, F.concat(F.lit("Abstract: "), cut("abstract", JUDGE_CHARS)))


def title_line() -> Column:
    return F.concat(F.lit("["), F.col("pmid").cast("string"), F.lit("] "), text_or_empty("title"))


def context(papers: DataFrame, order: str, block: Column | None = None) -> DataFrame:
    """Each question's papers as one text, in order, a blank line between: question_id, block, valid_ids, n_papers. The
    papers of a question are few: those that selection left."""
    row = F.struct(F.col(order).alias("o"), (paper_block() if block is None else block).alias("b"), F.col("pmid"))
    rows = papers.groupBy("question_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return rows.select("question_id", F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("block"), F.transform("r", lambda x: x["pmid"]).alias("valid_ids"), F.size("r").alias("n_papers"))


def answer_prompt(question: Column, block: Column, markdown: bool = True) -> Column:
    """What the model is asked for an answer."""
    form = "Write Markdown with the sections '## Short answer' and '## Evidence basis'." if markdown else "Write plain text without headings, and end with a line 'Evidence basis:'."
    rules = "Use only the papers below and cite each claim as [PMID]. Name the kind of study that a claim rests on; observational, animal and laboratory findings do not show a cause."
    return F.concat(F.lit("Question: "), text_or_empty(question), F.lit(f"\n\n{rules} {form}\n\n"), block)


def note_prompt(topic: Column) -> Column:
    """What the model is asked for a note on one paper."""
    return F.concat(F.lit("Topic: "), text_or_empty(topic), F.lit("\n\nNote in two or three sentences what this paper found, in whom and how, and cite it as [PMID]. Add nothing that the abstract does not say.\n\n"), paper_block())


def summary_prompt(topic: Column, block: Column, markdown: bool = True) -> Column:
    """What the model is asked for a summary of several papers or of the notes on them."""
    form = "Write Markdown." if markdown else "Write plain text."
    return F.concat(F.lit("Topic: "), text_or_empty(topic), F.lit(f"\n\nSummarise what these papers together show, where they agree and where not, and cite each as [PMID]. {form}\n\n"), block)


def judge_prompt(question: Column) -> Column:
    """What the judge is asked about one paper."""
    ask = "Reply with JSON: relevance (0 to 3; 3 only if it answers the question), answers_question, evidence_type, population_or_model, reason."
    return F.concat(F.lit("Question: "), text_or_empty(question), F.lit(f"\n\n{ask}\n\n"), judge_block())


def answer(papers: DataFrame, questions: DataFrame, generate: Generate = first_ids, order: str = "selected_pos", markdown: bool = True) -> DataFrame:
    """question_id, question, valid_ids and the model's answer for each question that has papers. papers: question_id,
    the order column and a paper's columns."""
    met = context(papers, order).join(questions, "question_id")
    return met.select("question_id", "question", "valid_ids", generated(answer_prompt(F.col("question"), F.col("block"), markdown), generate).alias("answer"))


def notes(papers: DataFrame, generate: Generate = title_note, topic: str = "question") -> DataFrame:
    """One validated note for each question's papers: question_id, pmid, note. A note may cite its own paper only."""
    made = papers.select("question_id", "pmid", generated(note_prompt(F.col(topic)), generate).alias("note"), F.array(F.col("pmid")).alias("valid_ids"))
    return C.validate(made.withColumn("note", F.trim("note")), "note").select("question_id", "pmid", "note")


def summarize(papers: DataFrame, generate: Generate = first_ids, note: Generate = title_note, order: str = "pos", topic: str = "question", markdown: bool = True, map_reduce: bool = False, least: int = MAP_REDUCE) -> DataFrame:
    """A validated summary of each question's papers: question_id, n_papers, mapped, summary. Of ``least`` papers or more
    (of all, with map_reduce) it is made of a note on each paper, else of the papers. papers: question_id, the topic and
    order columns and a paper's columns."""
    sizes = papers.groupBy("question_id").agg(F.count("*").alias("_n"), F.max(topic).alias("_topic"))
    met = papers.join(sizes, "question_id")
    many = F.lit(True) if map_reduce else F.col("_n") >= least
    mapped = met.where(many)
    noted = context(mapped.join(notes(mapped, note, topic), ["question_id", "pmid"]), order, note_block()).withColumn("mapped", F.lit(True))
    whole = context(met.where(~many), order).withColumn("mapped", F.lit(False))
    both = noted.unionByName(whole).join(sizes, "question_id")
    made = both.select("question_id", "n_papers", "mapped", "valid_ids", F.trim(generated(summary_prompt(F.col("_topic"), F.col("block"), markdown), generate)).alias("summary"))
    return C.validate(made, "summary").select("question_id", "n_papers", "mapped", "summary")


def judge(papers: DataFrame, generate: Generate = overlap_judge, question: str = "question") -> DataFrame:
    """papers plus relevance (0..3), evidence_type, answers_question, population_or_model, reason and error of a judge's
    reply on each. A paper that the judge fails on has an error and nothing else; the others of its batch are judged."""

    @F.pandas_udf("reply string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        try:
            rows = [(r, None) for r in generate(prompts.tolist())]
        except Exception:  # noqa: BLE001  one of them failed: each on its own
            for p in prompts:
                try:
                    rows.append((generate([p])[0], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["reply", "error"])

    asked = papers.withColumn("_r", run(judge_prompt(F.col(question)))).withColumns({"reply": F.col("_r.reply"), "error": F.col("_r.error")}).drop("_r")
    out = evaluate.normalize_judgement(asked)
    failed = F.col("error").isNotNull()
    return out.withColumns({c: F.when(~failed, F.col(c)) for c in ("evidence_type", "answers_question", "population_or_model", "reason")}).drop("reply")


def check_request(question: str, top: int = 10, pool: int = 30, context: int = 8) -> dict:
    """A request to answer a question, within bounds; ValueError outside of them."""
    bounds = {"question": (len(question), 3, 1000), "top": (top, 1, 25), "pool": (pool, 1, 100), "context": (context, 1, 20)}
    if bad := [f"{k} must be {low} to {high}, not {n}" for k, (n, low, high) in bounds.items() if not low <= n <= high]:
        raise ValueError("; ".join(bad))
    return {"question": question, "top": top, "pool": pool, "context": context}


def response(answers: DataFrame, papers: DataFrame) -> DataFrame:
    """What a service returns for each question (question_id, json): answer, its citation status and the chosen papers.
    answers: question_id, question, answer, valid_ids; papers: question_id, pmid, selected_pos, title, year, journal."""
    status = C.citation_status(answers)
    shown = F.struct(F.col("selected_pos").alias("o"), F.struct("pmid", "title", "year", "journal").alias("p"))
    listed = papers.groupBy("question_id").agg(F.array_sort(F.collect_list(shown)).alias("x"))
    citations = F.struct(F.col("cited").alias("cited_pmids"), F.col("invalid_cited").alias("invalid_pmids"), F.col("unbracketed").alias("unbracketed_pmids"), "format_warning", "validation_warning", "normalization_note")
    made = F.to_json(F.struct("question", "answer", citations.alias("citation_status"), F.transform("x", lambda v: v["p"]).alias("papers")))
    return status.join(listed, "question_id").select("question_id", made.alias("json"))
