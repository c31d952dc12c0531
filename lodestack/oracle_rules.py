"""DuckDB SQL of the rule queries, written from the definitions and not from the engine's expressions.

Only the word lists and parameters, which are fixed values, are shared with the engine. A pair's flags are computed once
(``k``), each as a count of the list's entries that stand in the text; scores are sums over the flags.
"""

from __future__ import annotations

from lodestack.functions import lexicon as L
from lodestack.plans.fixtures import with_views

OUTER = r"[^\p{L}\p{N}_]"


def words(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def any_in(text: str, terms) -> str:
    return f"(len(list_filter({words(terms)}, lambda w: contains({text}, w))) > 0)"


def found(text: str, pattern: str) -> str:
    r"""RE2 knows ASCII word boundaries only, so \b is spelt out: before a pattern or alternative, and after it."""
    spelt = "|".join((rf"(?:^|{OUTER})" if p.startswith(r"\b") else "") + p.removeprefix(r"\b").removesuffix(r"\b") + (rf"(?:$|{OUTER})" if p.endswith(r"\b") else "") for p in alternatives(pattern))
    return f"regexp_matches({text}, '{spelt}')"


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, at its top level."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


PAIRS = f"""{with_views('papers', 'probes')}, pairs AS (
  SELECT DISTINCT p.*, question_id, question FROM papers p JOIN probes ON question_id = p.pmid % 11 OR question_id = (p.pmid * 7 + 3) % 11
), r AS (
  SELECT question_id, pmid, (pmid % 100) / 100e0 AS score, (pmid % 7) / 7e0 AS impact, lower(question) AS q, lower(coalesce(title, '')) AS title, lower(coalesce(pubtypes, '')) AS pub,
    lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(pubtypes, '')) AS t FROM pairs
)"""

MURINE = ["mouse", "mice", "rat", "murine", "cell", "in vitro"]
LABORATORY = ["cell", "mouse", "mice", "rat", "in vitro"]
_tag = L.TEXT_TAGS
FLAGS = {
    # the question
    "q_manage": any_in("q", L.MANAGEMENT_QUERY), "q_adjunct": any_in("q", L.ADJUNCTIVE_QUERY), "q_behave": any_in("q", L.BEHAVIORAL_QUERY), "q_clinical": any_in("q", L.CLINICAL_QUERY),
    "q_mech": any_in("q", L.INTENT_MECHANISM), "q_prognosis": f"({any_in('q', L.INTENT_PROGNOSIS)} OR ({any_in('q', L.INTENT_SURVIVAL)} AND NOT contains(q, 'prevent')))",
    "q_risk": any_in("q", L.INTENT_RISK), "q_supp": "contains(q, 'supplement')", "q_cinv": f"(contains(q, 'chemo') AND {any_in('q', L.EMESIS_QUERY)})", "q_endpoint": any_in("q", L.INTENT_OUTCOMES),
    "q_safety": any_in("q", L.SAFETY_QUERY), "q_nondrug": any_in("q", L.CINV_NOT_DRUG_QUERY), "q_child": any_in("q", L.CHILD), "q_adult": "contains(q, 'adult')",
    "q_sugar": any_in("q", ["diabetes", "sglt2", "metformin"]), "q_kidney": any_in("q", ["kidney", "renal"]),
    # kinds of study
    "lab": any_in("t", LABORATORY), "lab_title": any_in("title", MURINE), "lab_any": any_in("t", MURINE), "human": any_in("t", L.HUMAN), "human_title": any_in("title", L.HUMAN),
    "safety": any_in("title", L.SAFETY_TITLE), "narrow": any_in("title", L.NARROW_TITLE), "broad": any_in("title", L.BROAD_TITLE), "pilot": any_in("title", L.PILOT),
    "drug": any_in("t", L.CINV_DRUG), "drug_title": any_in("title", L.CINV_DRUG_TITLE), "nondrug_title": any_in("title", L.CINV_NOT_DRUG_TITLE),
    "care_title": f"({any_in('title', L.CINV_CARE_TITLE)} AND {any_in('title', L.CINV_CONTEXT_TITLE)})", "nondrug": any_in("t", L.CINV_NOT_DRUG),
    # tags
    "g_guide": f"({any_in('pub', L.GUIDELINE_PUB)} OR {any_in('title', L.GUIDELINE_TITLE)})", "g_synth": f"({any_in('pub', L.SYNTHESIS_PUB)} OR {any_in('title', L.SYNTHESIS_TITLE)})",
    "g_trial": f"({any_in('pub', L.TRIAL_PUB)} OR {any_in('title', L.TRIAL_TITLE)})", "g_observed": f"({any_in('pub', L.OBSERVATIONAL)} OR {any_in('t', L.OBSERVATIONAL)})",
    "g_mech": any_in("t", _tag["mechanistic"]), "g_diag": any_in("t", _tag["diagnostic"]), "g_risk": any_in("t", _tag["risk_factor"]), "g_pharma": any_in("t", _tag["pharmacologic"]),
    "g_surgery": any_in("t", _tag["procedure_or_surgery"]), "g_behave": any_in("t", _tag["behavioral_or_psychological"]), "g_rehab": any_in("t", _tag["physical_therapy_or_rehab"]),
    "g_diet": any_in("t", _tag["diet_or_supplement"]), "g_other": any_in("t", _tag["complementary_or_alternative"]), "g_device": any_in("t", _tag["device"]),
    # populations
    "adult": "contains(t, 'adult')", "adult_title": "contains(title, 'adult')", "child": any_in("t", L.CHILD), "child_title": any_in("title", L.CHILD), "young": any_in("t", L.YOUNG), "young_title": any_in("title", L.YOUNG),
}
DERIVED = {
    "animal": "((lab_title AND NOT human_title) OR (lab_any AND NOT human))", "pharm": "(NOT nondrug_title AND (drug OR drug_title OR care_title))",
    "q_outcome": "(q_endpoint OR q_cinv)", "adjunct": "(g_other OR g_diet OR (g_behave AND NOT q_behave))",
}


def steps(**more: str) -> str:
    """The pairs with all flags, and what follows from them."""
    listed = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())
    return f"{PAIRS}, f AS (SELECT *, {listed(FLAGS)} FROM r), k AS (SELECT *, {listed(DERIVED)} FROM f)" + "".join(f", {n} AS ({e})" for n, e in more.items()) + " "


INTENTS = "list_sort(list_filter([CASE WHEN q_manage THEN 'clinical_management' END, CASE WHEN q_mech THEN 'mechanism' END, CASE WHEN q_prognosis THEN 'prognosis_survival' END, CASE WHEN q_risk THEN 'risk_prevention' END, CASE WHEN q_outcome THEN 'clinical_outcomes' END, CASE WHEN q_supp THEN 'supplementation' END, CASE WHEN q_cinv THEN 'cinv_management' END], lambda x: x IS NOT NULL))"
INTENT_LIST = f"coalesce(nullif(array_to_string({INTENTS}, ','), ''), 'general_clinical')"
#: The first tier whose test holds, with its weight.
TIERS = """SELECT *, CASE
    WHEN contains(pub, 'guideline') OR contains(title, 'guideline') OR contains(title, 'consensus') OR contains(title, 'recommendations') THEN {'k': 'guideline_or_consensus', 's': 4.2e0}
    WHEN contains(pub, 'meta-analysis') OR regexp_matches(title, 'meta[- ]analysis') THEN {'k': 'meta_analysis', 's': 4e0}
    WHEN contains(pub || '#' || title, 'systematic review') THEN {'k': 'systematic_review', 's': 3.8e0}
    WHEN contains(pub, 'randomized controlled trial') OR regexp_matches(title, 'randomi[sz]ed') THEN {'k': 'randomized_trial', 's': 3.6e0}
    WHEN contains(t, 'cohort') THEN {'k': 'cohort', 's': 2.8e0}
    WHEN contains(t, 'case-control') OR contains(title, 'case control') THEN {'k': 'case_control', 's': 2.5e0}
    WHEN contains(pub || '#' || title, 'review') THEN {'k': 'review', 's': 2e0}
    WHEN lab_any OR contains(t, 'pathway') OR contains(t, 'mechanism') THEN {'k': 'mechanistic', 's': 1e0}
    WHEN regexp_matches(pub, 'editorial|comment|letter|news') THEN {'k': 'editorial', 's': 0.6e0}
    ELSE {'k': 'other', 's': 1.2e0} END AS tier FROM k"""
_TAGS = {
    "guideline_or_consensus": "g_guide", "systematic_review_or_meta_analysis": "g_synth", "randomized_trial": "g_trial", "observational": "g_observed", "mechanistic": "g_mech", "diagnostic": "g_diag", "risk_factor": "g_risk",
    "pharmacologic": "g_pharma", "procedure_or_surgery": "g_surgery", "behavioral_or_psychological": "g_behave", "physical_therapy_or_rehab": "g_rehab", "diet_or_supplement": "g_diet", "complementary_or_alternative": "g_other", "device": "g_device",
}
TAG_LIST = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {f} THEN '{n}' END" for n, f in _TAGS.items()) + "], lambda x: x IS NOT NULL)), ',')"
_n = lambda c: f"({c})::INT"
CENTRALITY = f"""round(3e0 * {_n('g_guide')} + 2.2e0 * {_n('g_synth')} + 1.8e0 * {_n('g_trial')} + 1.2e0 * {_n('g_pharma')} + 1.2e0 * {_n('q_behave AND (g_behave OR g_rehab)')} + 2e0 * {_n('broad')}
  + CASE WHEN {any_in('title', L.CARE_TITLE)} THEN 1e0 WHEN {any_in('t', L.CARE_TEXT)} THEN 0.5e0 ELSE 0e0 END + 2e0 * {_n('q_cinv AND pharm')} - 1.8e0 * {_n('adjunct AND NOT q_adjunct')} - 2e0 * {_n('animal')}
  - 0.8e0 * {_n('g_mech AND NOT g_trial AND NOT g_synth AND NOT g_guide')} - 1.8e0 * {_n('narrow AND NOT q_adjunct')} - 0.8e0 * {_n('pilot')}, 4)"""
#: Endpoint rules by intent: [condition, weight, penalty].
ENDPOINTS = f"""[
  {{'c': q_mech AND {any_in('t', L.E_MECHANISM)}, 'w': 2.5e0, 'p': ''}}, {{'c': q_mech AND lab, 'w': 0.8e0, 'p': ''}},
  {{'c': q_risk AND {any_in('t', L.E_RISK)}, 'w': 2e0, 'p': ''}}, {{'c': q_risk AND {any_in('title', L.E_RISK_TITLE)}, 'w': 1e0, 'p': ''}},
  {{'c': q_risk AND {any_in('t', L.E_SURVIVAL)}, 'w': -2e0, 'p': 'survival/prognosis endpoint for risk/prevention question'}},
  {{'c': q_risk AND {any_in('t', L.E_TREATMENT)} AND NOT {any_in('t', L.E_NOT_TREATMENT)}, 'w': -0.8e0, 'p': 'treatment endpoint for risk/prevention question'}},
  {{'c': q_risk AND lab, 'w': -0.8e0, 'p': 'mechanistic evidence for risk/prevention question'}},
  {{'c': q_prognosis AND {any_in('t', L.E_PROGNOSIS)}, 'w': 2e0, 'p': ''}}, {{'c': q_prognosis AND {any_in('title', L.E_PROGNOSIS_TITLE)}, 'w': 1e0, 'p': ''}},
  {{'c': q_prognosis AND {any_in('t', L.E_CELL)}, 'w': -0.8e0, 'p': 'cell-line evidence for prognosis question'}},
  {{'c': q_manage AND {any_in('t', L.E_MANAGEMENT)}, 'w': 1.6e0, 'p': ''}}, {{'c': q_manage AND {any_in('title', L.E_MANAGEMENT_TITLE)}, 'w': 1e0, 'p': ''}},
  {{'c': q_manage AND animal, 'w': -2e0, 'p': 'animal/cell-line evidence for management question'}},
  {{'c': q_outcome AND {any_in('t', L.E_OUTCOMES)}, 'w': 1.5e0, 'p': ''}}, {{'c': q_outcome AND {any_in('t', L.E_SURROGATE)}, 'w': -0.4e0, 'p': 'surrogate endpoint'}},
  {{'c': q_outcome AND animal, 'w': -2.5e0, 'p': 'animal/cell-line evidence for clinical outcome question'}},
  {{'c': q_outcome AND NOT animal AND lab, 'w': -0.7e0, 'p': 'mechanistic evidence for clinical outcome question'}},
  {{'c': q_outcome AND safety AND NOT q_safety, 'w': -1e0, 'p': 'safety/adverse endpoint for non-safety question'}},
  {{'c': q_cinv AND {any_in('t', L.CINV_CHEMO)} AND {any_in('t', L.EMESIS_QUERY)}, 'w': 2e0, 'p': ''}}, {{'c': q_cinv AND pharm, 'w': 2.6e0, 'p': ''}},
  {{'c': q_cinv AND ({any_in('title', L.CINV_TITLE)} OR contains(title, 'medical treatment')), 'w': 1e0, 'p': ''}},
  {{'c': q_cinv AND nondrug AND NOT q_nondrug, 'w': -1.8e0, 'p': 'non-pharmacologic CINV intervention for broad chemotherapy vomiting question'}},
  {{'c': q_cinv AND {any_in('title', L.CHILD_TITLE)} AND NOT q_child, 'w': -1e0, 'p': 'pediatric CINV evidence for broad/adult-unspecified question'}}]"""
EXPOSURES = "[" + ", ".join(f"{{'asked': {found('q', p)}, 'title': {any_in('title', t)}, 'text': {any_in('t', t)}, 'p': 'missing required exposure/entity term: {'/'.join(t[:3])}'}}" for t, p in L.EXPOSURES) + "]"
SCORED = {
    "tiers": TIERS,
    "e": f"SELECT *, list_filter({ENDPOINTS}, lambda x: x.c) AS ends, list_filter({EXPOSURES}, lambda x: x.asked) AS needs FROM tiers",
    "s": """SELECT *, coalesce(list_sum(list_transform(ends, lambda x: x.w)), 0e0) AS endpoint, list_filter(list_transform(ends, lambda x: x.p), lambda p: p <> '') AS end_penalties,
      coalesce(list_sum(list_transform(needs, lambda x: CASE WHEN x.title THEN 1.5e0 WHEN x.text THEN 0.8e0 ELSE -4e0 END)), 0e0) AS exposure,
      list_transform(list_filter(needs, lambda x: NOT x.text), lambda x: x.p) AS need_penalties,
      CASE WHEN q_adult AND adult_title THEN 1.8e0 WHEN q_adult AND adult THEN 1.2e0 ELSE 0e0 END + CASE WHEN NOT q_adult THEN 0e0 WHEN child_title AND NOT adult_title THEN -5e0 WHEN child AND NOT adult THEN -3e0
        WHEN young_title THEN -2.5e0 WHEN young THEN -1.5e0 ELSE 0e0 END + CASE WHEN q_sugar AND regexp_matches(t, 'diabetes|diabetic|type 2') THEN 0.5e0 ELSE 0e0 END
        + CASE WHEN q_kidney AND regexp_matches(t, 'kidney|renal|ckd|egfr') THEN 0.5e0 ELSE 0e0 END AS population,
      CASE WHEN NOT q_adult THEN NULL WHEN child_title AND NOT adult_title THEN 'pediatric title for adult question' WHEN child AND NOT adult THEN 'pediatric population for adult question'
        WHEN young_title THEN 'mixed/younger title for adult question' WHEN young THEN 'mixed/younger population for adult question' END AS age_penalty, """ + f"{CENTRALITY} AS central FROM e",
}
CONFLICT = f"({found('t', L.NEGATION)} AND {any_in('t', L.CONFLICT)})"
_pick = lambda cols: steps(**SCORED) + f"SELECT question_id, pmid, {cols} FROM s"

RULES: dict[str, str] = {
    "infer_intent": f"""{with_views('probes')}, f AS (SELECT *, {", ".join(f"{FLAGS[n]} AS {n}" for n in FLAGS if n.startswith('q_'))} FROM (SELECT *, lower(question) AS q FROM probes)), k AS (SELECT *, q_endpoint OR q_cinv AS q_outcome FROM f)
      SELECT question_id, {INTENT_LIST} AS intents, q_adjunct AS adjunctive, q_behave AS behavioral, q_clinical AS clinical FROM k""",
    "evidence_tier": _pick("tier.k AS tier, tier.s AS tier_score"),
    "intervention_tags": _pick(f"{TAG_LIST} AS tags"),
    "endpoint_score": _pick("round(endpoint, 4) AS endpoint, array_to_string(end_penalties, '; ') AS penalties"),
    "exposure_score": _pick("round(exposure, 4) AS exposure, array_to_string(need_penalties, '; ') AS penalties"),
    "population_score": _pick("round(population, 4) AS population, age_penalty AS penalty"),
    "centrality": _pick("central AS centrality"),
    "signals": _pick(f"{CONFLICT} AS conflict, animal, safety, narrow, pharm AS cinv_drug, nondrug AS cinv_other"),
    "score_paper": _pick(f"""round(tier.s + exposure + endpoint + population + 0.35e0 * least(score, 2e0) + 0.25e0 * impact + CASE WHEN q_manage THEN central ELSE 0e0 END
      - CASE WHEN NOT q_mech AND tier.k = 'mechanistic' THEN 1.5e0 ELSE 0e0 END - CASE WHEN tier.k = 'editorial' THEN 1e0 ELSE 0e0 END, 4) AS evidence_score, tier.k AS evidence_tier, tier.s AS tier_score,
      round(exposure, 4) AS exposure_score, round(endpoint, 4) AS endpoint_score, round(population, 4) AS population_score, {TAG_LIST} AS intervention_tags, CASE WHEN q_manage THEN central ELSE 0e0 END AS management_centrality_score,
      {CONFLICT} AS conflict_signal, array_to_string(list_concat(need_penalties, end_penalties, CASE WHEN age_penalty IS NULL THEN [] ELSE [age_penalty] END), '; ') AS penalties, {INTENT_LIST} AS intents"""),
}

# The impact of a paper from its year, citation_count and rcr, and the boost of its kind of study.
AGE = "CASE WHEN year >= 1800 AND year <= 2027 THEN greatest(0.5e0, (2026 - year + 1)::DOUBLE) END"
RECENCY = f"coalesce(least(1e0, greatest(0.1e0, exp(-({AGE}) / 8e0))), 0.1e0)"
RATE = f"coalesce(least(1e0, greatest(0.1e0, ln(1e0 + greatest(citation_count, 0) / coalesce({AGE}, 1e0)) / ln(26e0))), 0.1e0)"
BASE = "coalesce(1e0 / (1e0 + exp(1e0 - rcr)), least(1e0, greatest(0.1e0, ln(1e0 + citation_count) / ln(1001e0))), 0.1e0)"
IMPACT = f"least(1e0, greatest(0.1e0, 0.55e0 * {BASE} + 0.3e0 * {RATE} + 0.15e0 * {RECENCY}))"
CLINICALISH = any_in("ev", L.SYNTHESIS + L.TRIALISH + L.REVIEWISH)
_m = "CASE WHEN clinical THEN 2e0 ELSE 1e0 END"
BOOST = f"""least(0.15e0, greatest(-0.15e0, ({_m}) * (0.05e0 * {_n(any_in('ev', L.SYNTHESIS))} + 0.04e0 * {_n(any_in('ev', L.TRIALISH))} + 0.02e0 * {_n(any_in('ev', L.REVIEWISH))})
  - 0.06e0 * {_n('clinical AND ' + any_in('ev', L.MECHANISTICISH))} - 0.036e0 * {_n(any_in('ev', L.CASES))}))"""
FINAL = "rel + 0.1e0 * impact + 0.02e0 * overlap + 0.04e0 * (focus_overlap + 2 * entity + concept + title_entity + title_concept + anchor + title_anchor) + boost"
CLINICAL_Q = any_in("q", L.CLINICAL_QUERY)
