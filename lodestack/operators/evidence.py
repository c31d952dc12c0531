"""Evidence scores of papers for a question, and the rule-based choice of a subset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.config import DEFAULT, Settings
from lodestack.functions import rules
from lodestack.functions import text as T
from lodestack.functions.udfs import ratio


#: What score_paper adds. Conditions that several of them need are columns of their own first (STEPS), so that none is
#: written out many times in one expression.
SCORES = ["evidence_score", "evidence_tier", "tier_score", "exposure_score", "endpoint_score", "population_score", "intervention_tags", "management_centrality_score", "conflict_signal", "penalties", "intents"]
STEPS = [
    {"_mech": rules.INTENTS["mechanism"], "_manage": rules.INTENTS["clinical_management"], "evidence_tier": rules.TIER, "_exposure": rules.exposure_score(), "_missing": rules.exposure_penalties()},
    {"_endpoint": rules.ENDPOINT_SCORE, "_ends": rules.ENDPOINT_PENALTIES},
    {"_population": rules.POPULATION_SCORE, "_age": rules.POPULATION_PENALTY, "intents": rules.INTENT_LIST, "conflict_signal": rules.CONFLICT},
    {"_central": rules.CENTRALITY, "intervention_tags": rules.TAG_LIST},
    {"tier_score": rules.TIER_SCORES, "management_centrality_score": "CASE WHEN _manage THEN _central ELSE 0e0 END"},
    {
        "evidence_score": "round(tier_score + _exposure + _endpoint + _population + least(coalesce(score, 0e0), 2e0) * 0.35e0 + coalesce(impact, 0e0) * 0.25e0 + management_centrality_score"
        " - CASE WHEN NOT _mech AND evidence_tier = 'mechanistic' THEN 1.5e0 ELSE 0e0 END - CASE WHEN evidence_tier = 'editorial' THEN 1e0 ELSE 0e0 END, 4)",
        "exposure_score": "round(_exposure, 4)", "endpoint_score": "round(_endpoint, 4)", "population_score": "round(_population, 4)", "penalties": "concat_ws('; ', nullif(_missing, ''), nullif(_ends, ''), _age)",
    },
]


def with_scores(pairs: DataFrame) -> DataFrame:
    out = T.with_rule_columns(pairs)
    for step in STEPS:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out.drop(*[k for step in STEPS for k in step if k[0] == "_"])


def score_paper(pairs: DataFrame) -> DataFrame:
    """pairs of a paper and a question (title, abstract, pubtypes, question, score, impact) with all evidence scores.

    List results (tags, penalties, intents) are joined strings. Null texts count as empty, null scores as 0.
    """
    return with_scores(pairs).withColumn("title", F.col("raw_title")).drop("raw_title")


#: Flags that the selection needs besides score_paper's columns.
FLAGS = {"narrow": rules.NARROW, "animal": rules.ANIMAL_ONLY, "safety": rules.SAFETY, "cinv_drug": rules.CINV_PHARM, "cinv_other": f"({rules.CINV_NONPHARM} AND NOT {rules.CINV_PHARM})", "adjunct": f"({rules.ADJUNCTIVE} AND NOT {rules.TAGS['pharmacologic']})", "safety_q": rules.SAFETY_Q, "adjunctive_q": rules.ADJUNCTIVE_Q}


class Selection:
    """The papers chosen so far for one question, in order, and the caps they obey."""

    def __init__(self, rows: list[dict], most: int, least: int):
        self.rows = sorted(rows, key=lambda r: -r["evidence_score"])  # stable
        self.most, self.target = most, min(most, max(least, len(rows)))
        intents = rows[0]["intents"].split(",")
        self.mechanism, self.cinv, self.management = "mechanism" in intents, "cinv_management" in intents, "clinical_management" in intents
        self.safety_q, self.capped = rows[0]["safety_q"], "clinical_management" in intents and not rows[0]["adjunctive_q"]
        self.mech_cap = most

    @staticmethod
    def excluded(r: dict) -> bool:
        return rules.MISSING in r["penalties"] or "pediatric title for adult question" in r["penalties"]

    def mechanistic(self, r: dict) -> bool:
        return r["evidence_tier"] == "mechanistic" and not (self.cinv and r["cinv_drug"])

    def first_pass(self) -> list[dict]:
        chosen: list[dict] = []

        def take(r: dict) -> None:
            if r["pmid"] not in {c["pmid"] for c in chosen} and not self.excluded(r) and not any(ratio(r["_norm"], c["_norm"]) >= 0.90 for c in chosen):
                chosen.append(r)

        for r in self.rows:
            if len(chosen) < self.most:
                take(r)
        if len(chosen) < self.most and not any(c["conflict_signal"] for c in chosen):
            for r in [r for r in self.rows if r["conflict_signal"] and r["evidence_tier"] != "editorial"][:1]:
                take(r)
        return chosen

    def prune(self, chosen: list[dict]) -> list[dict]:
        """Caps on mechanistic, non-drug, narrow and adjunctive papers; clinical ones come first."""
        if not self.mechanism:
            clinical, mech = [r for r in chosen if not self.mechanistic(r)], [r for r in chosen if self.mechanistic(r)]
            if self.cinv:
                others = [r for r in clinical if r["cinv_other"]][: 1 if any(r["cinv_drug"] for r in clinical) else 2]
                clinical = [r for r in clinical if not r["cinv_other"] or any(r is o for o in others)]
            if len(clinical) >= 2 and not self.safety_q:
                clinical = [r for r in clinical if not r["safety"]]
            self.mech_cap = 1 if len(clinical) >= 2 else 2
            if len(clinical) >= 2:
                mech = [r for r in mech if not r["animal"]]
            chosen = clinical + mech[: self.mech_cap]
        if self.capped:
            for flag, cap in (("narrow", self.narrow_cap), ("adjunct", self.adjunct_cap)):
                core = [r for r in chosen if not r[flag]]
                chosen = core + [r for r in chosen if r[flag]][: cap(len(core))]
        return chosen

    @staticmethod
    def narrow_cap(core: int) -> int:
        return 1 if core >= 4 else 2

    @staticmethod
    def adjunct_cap(core: int) -> int:
        return 2 if core >= 4 or not core else 1

    def barred(self, r: dict, chosen: list[dict]) -> bool:
        """Whether the caps keep r out when gaps are filled."""
        count = lambda test: sum(map(test, chosen))
        if self.mechanism:
            return False
        if self.mechanistic(r) and count(lambda c: c["evidence_tier"] == "mechanistic") >= self.mech_cap:
            return True
        if self.cinv and r["cinv_other"] and count(lambda c: c["cinv_other"]) and count(lambda c: c["cinv_drug"]):
            return True
        if len(chosen) >= 2 and (r["animal"] or r["safety"] and not self.safety_q):
            return True
        if not self.capped:
            return False
        adjuncts, narrows = count(lambda c: c["adjunct"]), count(lambda c: c["narrow"])
        return r["adjunct"] and adjuncts >= self.adjunct_cap(len(chosen) - adjuncts) or r["narrow"] and narrows >= self.narrow_cap(len(chosen) - narrows)

    def run(self) -> list[dict]:
        chosen = self.prune(self.first_pass())
        taken = {r["pmid"] for r in chosen}
        for r in self.rows:
            if len(chosen) >= self.target:
                break
            if r["pmid"] not in taken and not self.excluded(r) and not self.barred(r, chosen):
                chosen.append(r)
                taken.add(r["pmid"])
        return chosen[: self.most]


def select_evidence(pairs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """A curated subset of each question's papers: score_paper's columns and selected_pos (from 1).

    Papers come in the order of the column ``rank``, which breaks ties of the evidence score. Each question's few
    dozen candidates are one grouped map, since every choice depends on those before it. max_selected 0 gives none.
    """
    ready = with_scores(pairs).withColumns({k: F.expr(v) for k, v in FLAGS.items()})
    ready = ready.withColumn("title", F.col("raw_title")).withColumn("_norm", T.norm_title("raw_title"))
    out = ["question_id", "pmid", "evidence_score", "evidence_tier", "intervention_tags", "penalties", "conflict_signal", "intents"]
    ready = ready.select(*out, "rank", "_norm", *FLAGS)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("rank", kind="stable").to_dict("records")
        kept = Selection(rows, s.max_selected, s.min_selected).run() if rows and s.max_selected > 0 else []
        return pd.DataFrame([{k: r[k] for k in out} | {"selected_pos": i + 1} for i, r in enumerate(kept)], columns=[*out, "selected_pos"])

    schema = "question_id long, pmid long, evidence_score double, evidence_tier string, intervention_tags string, penalties string, conflict_signal boolean, intents string, selected_pos int"
    return ready.groupBy("question_id").applyInPandas(choose, schema)
