"""From candidates to a context: filters, scores, near-duplicate titles, balanced quotas."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.config import DEFAULT, Settings
from lodestack.functions import rules, scoring
from lodestack.functions import text as T
from lodestack.storage import written


def features(questions: DataFrame, keywords: Callable[[Column], Column] | None = None) -> DataFrame:
    """Everything that the filters and scores need of (question_id, question)."""
    focus = T.focus_terms("question") if keywords is None else keywords(F.col("question"))
    q = questions.withColumns({"terms": T.query_terms("question"), "focus": focus, "phrases": T.required_phrases("question", focus), "entities": T.entity_groups("question", focus), "concepts": T.concept_groups("question"), "anchors": T.anchor_terms("question")})
    return q.withColumn("q", F.lower(T.text_or_empty("question"))).withColumn("clinical", F.expr(rules.CLINICAL_Q)).drop("q")


def measured(candidates: DataFrame) -> DataFrame:
    """Counts of matched terms and groups; candidates hold a paper's and its question's columns and rel."""
    body, title = T.content_text("title", "abstract"), F.lower(T.text_or_empty("title"))
    out = candidates.withColumns({"body": body, "low_title": title})
    b, t = F.col("body"), F.col("low_title")
    return out.withColumns({
        "overlap": T.overlap_count(b, F.col("terms")), "focus_overlap": T.overlap_count(b, F.col("focus")),
        "phrases_held": F.size(F.filter("phrases", lambda p: T.phrase_present(b, p))),
        "entity": T.groups_present(b, F.col("entities"), True), "concept": T.groups_present(b, F.col("concepts"), False),
        "title_entity": T.groups_present(t, F.col("entities"), True), "title_concept": T.groups_present(t, F.col("concepts"), False),
        "anchor": T.overlap_count(b, F.col("anchors")), "title_anchor": T.overlap_count(t, F.col("anchors")),
        "ev": F.lower(F.concat(T.text_or_empty("pubtypes"), F.lit(" "), T.text_or_empty("title"))),
    })


def candidate_filter(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Keeps measured candidates that meet every lexical requirement of their question."""
    return df.where(
        (F.length("body") >= s.min_chars)
        & (F.col("phrases_held") == F.size("phrases")) & (F.col("entity") == F.size("entities")) & (F.col("concept") == F.size("concepts"))
        & (F.col("anchor") >= T.anchor_least(F.col("anchors")))
        & ~((F.size("focus") > 0) & (F.col("focus_overlap") == 0) & (F.col("rel") < s.focus_min_rel))
        & ~((F.size("terms") > 0) & (F.col("overlap") < s.overlap_min) & (F.col("rel") < s.overlap_min_rel))
    )


def scored(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds impact, boost and the final score to measured candidates with year, citation_count and rcr."""
    out = df.withColumn("impact", F.expr(scoring.impact(s))).withColumn("boost", F.expr(scoring.boost(s)))
    return out.withColumn("score", F.round(F.expr(scoring.final_score(s)), 6))


def junk(title: str = "title", abstract: str = "abstract"):
    """Papers with no title to speak of and no abstract either."""
    n = F.length(T.norm_title(title))
    return (n == 0) | ((n < 8) & (F.length(F.trim(T.text_or_empty(abstract))) < 40))


def exact_title_dedup(df: DataFrame, order: str = "rank") -> DataFrame:
    """The first paper of each question and normal title; junk goes. A title's papers are merged before the shuffle."""
    own = F.struct(*df.columns)
    first = df.where(~junk()).groupBy("question_id", T.norm_title("title").alias("_norm")).agg(F.min_by(own, order).alias("x"))
    return first.select("x.*")


def title_classes(df: DataFrame, id_col: str = "pmid", title_col: str = "title") -> DataFrame:
    """(id, representative): papers of one set of title tokens, represented by the smallest id; those without tokens have
    none."""
    sets = df.select(F.col(id_col).alias("id"), F.array_sort(T.title_tokens(title_col)).alias("tokens")).filter(F.size("tokens") > 0)
    heads = sets.groupBy("tokens").agg(F.min("id").alias("representative"), F.count("*").alias("n"))
    hot = heads.filter("n > 1000")  # few: each has over a thousand papers
    met = sets.join(F.broadcast(hot.select("tokens", F.col("representative").alias("h"))) if hot.limit(1001).count() <= 1000 else hot.select("tokens", F.col("representative").alias("h")), "tokens", "left")
    cold = met.filter("h is null").drop("h").join(heads.filter("n <= 1000").select("tokens", "representative"), "tokens").select("id", "representative")
    return met.filter("h is not null").select("id", F.col("h").alias("representative")).unionByName(cold)


def title_jaccard_pairs(df: DataFrame, least: float, id_col: str = "pmid", title_col: str = "title") -> DataFrame:
    """Pairs of different sets of title tokens with a Jaccard similarity of ``least`` or more, by the smallest id of each:
    a, b, jaccard. Papers of one set count once here; :func:`title_classes` has them.

    Prefix filter: with the tokens of each title in order of rarity, similar titles share one of the first
    n - ceil(least n) + 1; only pairs that meet there are compared, each once.
    """
    all_sets = df.select(F.col(id_col).alias("id"), F.array_sort(T.title_tokens(title_col)).alias("tokens")).filter(F.size("tokens") > 0)
    sets = written(all_sets.groupBy("tokens").agg(F.min("id").alias("id")), "titles")
    df_of = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rare = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(df_of, "token")
    nth = Window.partitionBy("id").orderBy("df", "token")
    prefix = written(rare.withColumn("at", F.row_number().over(nth)).filter(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1), "prefixes")
    side = lambda k: prefix.select("token", F.col("id").alias(k), F.col("n").alias(f"n_{k}"))
    met = side("a").join(side("b"), "token").filter((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9)).select("a", "b").distinct()
    own = lambda k: sets.select(F.col("id").alias(k), F.col("tokens").alias(f"t_{k}"))
    jaccard = F.round(F.size(F.array_intersect("t_a", "t_b")) / F.size(F.array_union("t_a", "t_b")), 6)
    return met.join(own("a"), "a").join(own("b"), "b").select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= least)


class Kept:
    """The kept titles of one question, and whether a further one is near one of them."""

    def __init__(self, s: Settings):
        self.s, self.norms, self.words, self.matchers = s, set(), [], []
        self.counts, self.sizes = np.zeros((16, len(LETTERS)), np.int16), np.zeros(16, np.int64)

    def near(self, norm: str, own: frozenset, counts: np.ndarray) -> bool:
        """A title's ratio is at most what the letters that both have allow, so only titles beyond that are aligned."""
        if norm in self.norms or any(len(own & t) >= self.s.title_jaccard * max(1, len(own | t)) for t in self.words):
            return True
        n = len(self.words)
        both = np.minimum(self.counts[:n], counts).sum(axis=1)
        for i in np.flatnonzero(2.0 * both >= self.s.title_ratio * (self.sizes[:n] + len(norm)) - 1e-6):
            m = self.matchers[i]
            m.set_seq1(norm)
            if norm and m.b and m.ratio() >= self.s.title_ratio:
                return True
        return False

    def add(self, norm: str, own: frozenset, counts: np.ndarray) -> None:
        n = len(self.words)
        if n == len(self.sizes):
            self.counts, self.sizes = np.concatenate([self.counts, self.counts]), np.concatenate([self.sizes, self.sizes])
        self.counts[n], self.sizes[n] = counts, len(norm)
        self.norms.add(norm)
        self.words.append(own)
        self.matchers.append(SequenceMatcher(None, "", norm))


#: What normal titles are made of.
LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"


def greedy_dedup(df: DataFrame, s: Settings = DEFAULT, top_n: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Walks each question's papers by rank and drops junk and those near a kept title, until top_n * 4 (clinical
    questions) or * 2 are kept. Adds kept_rank. Needs question_id, rank, clinical, title, abstract; of these, and of what
    else df has, the columns ``keep`` are handed on (all, if it is not given), and only they go through the walk. The
    order matters, so each question (a few hundred candidates at most) is one grouped map."""
    top_n = top_n or s.context
    out = keep or df.columns
    own = [f"_own_{c}" for c in out]
    ready = df.where(~junk()).select(
        F.col("question_id").alias("_question"), F.col("rank").alias("_rank"), F.col("clinical").alias("_clinical"),
        T.norm_title("title").alias("_norm"), T.title_tokens("title").alias("_tokens"), *[F.col(c).alias(o) for c, o in zip(out, own, strict=True)],
    )
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in out)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        held, kept = Kept(s), []
        limit = top_n * (4 if len(group) and bool(group._clinical.iloc[0]) else 2)
        ordered = group.sort_values("_rank")
        for i, norm, toks in zip(ordered.index, ordered["_norm"], ordered["_tokens"], strict=True):
            if len(kept) >= limit:
                break
            title = norm, frozenset(toks), np.array([norm.count(c) for c in LETTERS], np.int16)
            if not held.near(*title):
                held.add(*title)
                kept.append(i)
        chosen = group.loc[kept, own].set_axis(out, axis=1)
        chosen["kept_rank"] = range(1, len(chosen) + 1)
        return chosen

    return ready.groupBy("_question").applyInPandas(walk, fields + ", kept_rank int")


def balanced_context(df: DataFrame, top_n: int, order: str = "rank", s: Settings = DEFAULT) -> DataFrame:
    """Up to a quota of clinical papers, then of mechanistic ones, then the rest, in rank order, top_n in all.

    Needs question_id, the order column, clinical (question flag) and ev. Adds context_group and context_pos.
    """
    group = F.when(F.expr(rules.CLINICALISH), 0).otherwise(1)
    out = df.withColumn("_g", group)
    nth = F.row_number().over(Window.partitionBy("question_id", "_g").orderBy(order))
    quota = F.when(F.col("_g") == 0, F.when(F.col("clinical"), s.clinical_quotas[0]).otherwise(s.quotas[0])).otherwise(F.when(F.col("clinical"), s.clinical_quotas[1]).otherwise(s.quotas[1]))
    out = out.withColumn("_phase", F.when(nth <= quota, F.col("_g")).otherwise(2))
    pos = F.row_number().over(Window.partitionBy("question_id").orderBy("_phase", order))
    named = F.when(F.col("_g") == 0, "clinical/review").otherwise("mechanistic/other")
    return out.withColumn("context_pos", pos).filter(F.col("context_pos") <= top_n).withColumn("context_group", named).drop("_g", "_phase")
