"""The scoring rules as SQL expressions over lower-case columns.

Columns: ``q`` question, ``title``, ``t`` title + abstract + publication types, ``pub`` publication types. The
Doubles are written with an exponent, since a plain 1.5 is a decimal.
"""

from __future__ import annotations

from lodestack.functions import lexicon as L


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, terms: list[str] | tuple[str, ...]) -> str:
    """Whether any of the terms is a substring."""
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")"


def matches(column: str, pattern: str) -> str:
    """Whether the pattern is found; word boundaries are those of Unicode."""
    return f"regexp_like({column}, r{quoted('(?U)' + pattern)})"


def add(*parts: tuple[str, float]) -> str:
    """Sum of weights whose condition holds."""
    return "(" + " + ".join(f"CASE WHEN {c} THEN {w}e0 ELSE 0e0 END" for c, w in parts) + ")"


def listed(separator: str, *parts: tuple[str, str]) -> str:
    """Labels whose condition holds, in the given order, joined; empty if none."""
    return f"concat_ws({quoted(separator)}, " + ", ".join(f"CASE WHEN {c} THEN {quoted(label)} END" for c, label in parts) + ")"


def both(*c: str) -> str:
    return "(" + " AND ".join(c) + ")"


def either(*c: str) -> str:
    return "(" + " OR ".join(c) + ")"


def no(c: str) -> str:
    return f"(NOT {c})"


MANAGEMENT_Q = has("q", L.MANAGEMENT_QUERY)
ADJUNCTIVE_Q = has("q", L.ADJUNCTIVE_QUERY)
BEHAVIORAL_Q = has("q", L.BEHAVIORAL_QUERY)
CLINICAL_Q = has("q", L.CLINICAL_QUERY)
I_CINV = both(has("q", L.CHEMO), has("q", L.EMESIS_QUERY))
INTENTS = {
    "cinv_management": I_CINV,
    "clinical_management": MANAGEMENT_Q,
    "clinical_outcomes": either(has("q", L.INTENT_OUTCOMES), I_CINV),
    "mechanism": has("q", L.INTENT_MECHANISM),
    "prognosis_survival": either(has("q", L.INTENT_PROGNOSIS), both(has("q", L.INTENT_SURVIVAL), no(has("q", L.INTENT_PREVENT)))),
    "risk_prevention": has("q", L.INTENT_RISK),
    "supplementation": has("q", L.INTENT_SUPPLEMENT),
}
INTENT_LIST = f"coalesce(nullif({listed(',', *[(c, k) for k, c in INTENTS.items()])}, ''), 'general_clinical')"

CLINICALISH = has("ev", L.SYNTHESIS + L.TRIALISH + L.REVIEWISH)


def evidence_boost(bonus: float, penalty: float, multiplier: float, mechanistic: float, limit: float) -> str:
    """From ``ev`` (publication types + title) and the flag ``clinical``."""
    m = f"(CASE WHEN clinical THEN {multiplier}e0 ELSE 1e0 END)"
    raw = (
        f"(CASE WHEN {has('ev', L.SYNTHESIS)} THEN {bonus}e0 * {m} ELSE 0e0 END + CASE WHEN {has('ev', L.TRIALISH)} THEN {bonus}e0 * 0.8e0 * {m} ELSE 0e0 END"
        f" + CASE WHEN {has('ev', L.REVIEWISH)} THEN {bonus}e0 * 0.4e0 * {m} ELSE 0e0 END - CASE WHEN clinical AND {has('ev', L.MECHANISTICISH)} THEN {mechanistic}e0 ELSE 0e0 END"
        f" - CASE WHEN {has('ev', L.CASES)} THEN {penalty}e0 * 1.2e0 ELSE 0e0 END)"
    )
    return f"greatest(-{limit}e0, least({limit}e0, {raw}))"


SAFETY = has("title", L.SAFETY_TITLE)
SAFETY_Q = has("q", L.SAFETY_QUERY)
NARROW = has("title", L.NARROW_TITLE)
ANIMAL_ONLY = either(both(has("title", L.PRECLINICAL_MURINE), no(has("title", L.HUMAN))), both(has("t", L.PRECLINICAL_MURINE), no(has("t", L.HUMAN))))
CINV_PHARM = both(no(has("title", L.CINV_NOT_DRUG_TITLE)), either(has("t", L.CINV_DRUG), has("title", L.CINV_DRUG_TITLE), both(has("title", L.CINV_CARE_TITLE), has("title", L.CINV_CONTEXT_TITLE))))
CINV_NONPHARM = has("t", L.CINV_NOT_DRUG)


CONFLICT = both(matches("t", L.NEGATION), has("t", L.CONFLICT))


#: Tiers in the order they are tried.
TIERS = [
    ("guideline_or_consensus", 4.2, either(has("pub", ["guideline"]), has("title", ["guideline", "consensus", "recommendations"]))),
    ("meta_analysis", 4.0, either(has("pub", ["meta-analysis"]), has("title", ["meta-analysis", "meta analysis"]))),
    ("systematic_review", 3.8, either(has("pub", ["systematic review"]), has("title", ["systematic review"]))),
    ("randomized_trial", 3.6, either(has("pub", ["randomized controlled trial"]), has("title", ["randomized", "randomised"]))),
    ("cohort", 2.8, has("t", ["cohort"])),
    ("case_control", 2.5, either(has("t", ["case-control"]), has("title", ["case control"]))),
    ("review", 2.0, either(has("pub", ["review"]), has("title", ["review"]))),
    ("mechanistic", 1.0, has("t", L.MECHANISTIC_TIER)),
    ("editorial", 0.6, has("pub", L.EDITORIAL)),
]
TIER = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in TIERS) + " ELSE 'other' END"
#: A tier's weight, from the column evidence_tier.
TIER_SCORES = "CASE evidence_tier " + " ".join(f"WHEN '{k}' THEN {s}e0" for k, s, _ in TIERS) + " ELSE 1.2e0 END"
TIER_SCORE = "CASE " + " ".join(f"WHEN {c} THEN {s}e0" for _, s, c in TIERS) + " ELSE 1.2e0 END"

TAGS = {k: has("t", v) for k, v in L.TEXT_TAGS.items()} | {
    "guideline_or_consensus": either(has("pub", L.GUIDELINE_PUB), has("title", L.GUIDELINE_TITLE)),
    "observational": either(has("pub", L.OBSERVATIONAL), has("t", L.OBSERVATIONAL)),
    "randomized_trial": either(has("pub", L.TRIAL_PUB), has("title", L.TRIAL_TITLE)),
    "systematic_review_or_meta_analysis": either(has("pub", L.SYNTHESIS_PUB), has("title", L.SYNTHESIS_TITLE)),
}
TAG_LIST = listed(",", *[(TAGS[k], k) for k in sorted(TAGS)])
ADJUNCTIVE = either(TAGS["complementary_or_alternative"], TAGS["diet_or_supplement"], both(no(BEHAVIORAL_Q), TAGS["behavioral_or_psychological"]))

CENTRALITY = "round(" + add(
    (TAGS["guideline_or_consensus"], 3.0),
    (TAGS["systematic_review_or_meta_analysis"], 2.2),
    (TAGS["randomized_trial"], 1.8),
    (TAGS["pharmacologic"], 1.2),
    (both(BEHAVIORAL_Q, either(TAGS["behavioral_or_psychological"], TAGS["physical_therapy_or_rehab"])), 1.2),
    (has("title", L.BROAD_TITLE), 2.0),
    (has("title", L.CARE_TITLE), 1.0),
    (both(no(has("title", L.CARE_TITLE)), has("t", L.CARE_TEXT)), 0.5),
    (both(I_CINV, CINV_PHARM), 2.0),
    (both(ADJUNCTIVE, no(ADJUNCTIVE_Q)), -1.8),
    (ANIMAL_ONLY, -2.0),
    (both(TAGS["mechanistic"], no(either(TAGS["randomized_trial"], TAGS["systematic_review_or_meta_analysis"], TAGS["guideline_or_consensus"]))), -0.8),
    (both(NARROW, no(ADJUNCTIVE_Q)), -1.8),
    (has("title", L.PILOT), -0.8),
) + ", 4)"

_I = INTENTS
_CARE_ONLY = both(has("t", L.E_TREATMENT), no(has("t", L.E_NOT_TREATMENT)))
_CINV_OTHER = both(CINV_NONPHARM, no(has("q", L.CINV_NOT_DRUG_QUERY)))
_CINV_CHILD = both(has("title", L.CHILD_TITLE), no(has("q", L.CHILD)))
#: Endpoint rules: intent, condition, weight, penalty label.
ENDPOINT = [
    ("mechanism", has("t", L.E_MECHANISM), 2.5, None),
    ("mechanism", has("t", L.PRECLINICAL), 0.8, None),
    ("risk_prevention", has("t", L.E_RISK), 2.0, None),
    ("risk_prevention", has("title", L.E_RISK_TITLE), 1.0, None),
    ("risk_prevention", has("t", L.E_SURVIVAL), -2.0, "survival/prognosis endpoint for risk/prevention question"),
    ("risk_prevention", _CARE_ONLY, -0.8, "treatment endpoint for risk/prevention question"),
    ("risk_prevention", has("t", L.PRECLINICAL), -0.8, "mechanistic evidence for risk/prevention question"),
    ("prognosis_survival", has("t", L.E_PROGNOSIS), 2.0, None),
    ("prognosis_survival", has("title", L.E_PROGNOSIS_TITLE), 1.0, None),
    ("prognosis_survival", has("t", L.E_CELL), -0.8, "cell-line evidence for prognosis question"),
    ("clinical_management", has("t", L.E_MANAGEMENT), 1.6, None),
    ("clinical_management", has("title", L.E_MANAGEMENT_TITLE), 1.0, None),
    ("clinical_management", ANIMAL_ONLY, -2.0, "animal/cell-line evidence for management question"),
    ("clinical_outcomes", has("t", L.E_OUTCOMES), 1.5, None),
    ("clinical_outcomes", has("t", L.E_SURROGATE), -0.4, "surrogate endpoint"),
    ("clinical_outcomes", ANIMAL_ONLY, -2.5, "animal/cell-line evidence for clinical outcome question"),
    ("clinical_outcomes", both(no(ANIMAL_ONLY), has("t", L.PRECLINICAL)), -0.7, "mechanistic evidence for clinical outcome question"),
    ("clinical_outcomes", both(SAFETY, no(SAFETY_Q)), -1.0, "safety/adverse endpoint for non-safety question"),
    ("cinv_management", both(has("t", L.CINV_CHEMO), has("t", L.EMESIS_QUERY)), 2.0, None),
    ("cinv_management", CINV_PHARM, 2.6, None),
    ("cinv_management", has("title", L.CINV_TITLE + ["medical treatment"]), 1.0, None),
    ("cinv_management", _CINV_OTHER, -1.8, "non-pharmacologic CINV intervention for broad chemotherapy vomiting question"),
    ("cinv_management", _CINV_CHILD, -1.0, "pediatric CINV evidence for broad/adult-unspecified question"),
]
ENDPOINT_SCORE = add(*[(both(_I[i], c), w) for i, c, w, _ in ENDPOINT])
ENDPOINT_PENALTIES = listed("; ", *[(both(_I[i], c), p) for i, c, _, p in ENDPOINT if p])

MISSING = "missing required exposure/entity term: "


def exposure_score() -> str:
    parts = []
    for terms, pattern in L.EXPOSURES:
        asked = matches("q", pattern)
        parts.append(f"CASE WHEN NOT {asked} THEN 0e0 WHEN {has('title', terms)} THEN 1.5e0 WHEN {has('t', terms)} THEN 0.8e0 ELSE -4e0 END")
    return "(" + " + ".join(parts) + ")"


def exposure_penalties() -> str:
    return listed("; ", *[(both(matches("q", p), no(has("t", terms))), MISSING + "/".join(terms[:3])) for terms, p in L.EXPOSURES])


_ADULT_Q = has("q", ["adult"])
_ADULT_T, _ADULT_TITLE = has("t", ["adult"]), has("title", ["adult"])
#: Younger populations for a question on adults, in the order they are tried.
YOUNGER = [
    (both(has("title", L.CHILD), no(_ADULT_TITLE)), -5.0, "pediatric title for adult question"),
    (both(has("t", L.CHILD), no(_ADULT_T)), -3.0, "pediatric population for adult question"),
    (has("title", L.YOUNG), -2.5, "mixed/younger title for adult question"),
    (has("t", L.YOUNG), -1.5, "mixed/younger population for adult question"),
]
POPULATION_SCORE = (
    f"(CASE WHEN NOT {_ADULT_Q} THEN 0e0 WHEN {_ADULT_TITLE} THEN 1.8e0 WHEN {_ADULT_T} THEN 1.2e0 ELSE 0e0 END"
    + f" + CASE WHEN NOT {_ADULT_Q} THEN 0e0 " + " ".join(f"WHEN {c} THEN {w}e0" for c, w, _ in YOUNGER) + " ELSE 0e0 END"
    + f" + {add((both(has('q', ['diabetes', 'sglt2', 'metformin']), has('t', ['diabetes', 'diabetic', 'type 2'])), 0.5), (both(has('q', ['kidney', 'renal']), has('t', ['kidney', 'renal', 'ckd', 'egfr'])), 0.5))})"
)
POPULATION_PENALTY = f"CASE WHEN NOT {_ADULT_Q} THEN NULL " + " ".join(f"WHEN {c} THEN {quoted(p)}" for c, _, p in YOUNGER) + " END"
