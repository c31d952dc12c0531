"""Impact, recency and evidence scores as SQL expressions shared by Spark and DuckDB.

They read year, citation_count and rcr (any of them null).
"""

from __future__ import annotations

from lodestack.config import DEFAULT, Settings
from lodestack.functions import rules


def age(s: Settings = DEFAULT) -> str:
    """Years since publication, at least half a year; null outside 1800..as_of_year + 1."""
    return f"(CASE WHEN year BETWEEN 1800 AND {s.as_of_year + 1} THEN greatest(0.5e0, CAST({s.as_of_year} - year + 1 AS DOUBLE)) END)"


def clamp(x: str, s: Settings) -> str:
    return f"greatest({s.impact_floor}e0, least(1e0, {x}))"


def recency(s: Settings = DEFAULT) -> str:
    return f"(CASE WHEN {age(s)} IS NULL THEN {s.impact_floor}e0 ELSE {clamp(f'exp(-{age(s)} / {s.half_life}e0)', s)} END)"


def citation_rate(s: Settings = DEFAULT) -> str:
    rate = f"greatest(0e0, CAST(citation_count AS DOUBLE)) / coalesce({age(s)}, 1e0)"
    return f"(CASE WHEN citation_count IS NULL THEN {s.impact_floor}e0 ELSE {clamp(f'ln(1e0 + {rate}) / ln({1 + s.rate_target}e0)', s)} END)"


def citation_base(s: Settings = DEFAULT) -> str:
    counted = clamp("ln(1e0 + CAST(citation_count AS DOUBLE)) / ln(1001e0)", s)
    return f"(CASE WHEN rcr IS NOT NULL THEN 1e0 / (1e0 + exp(-(rcr - 1e0))) WHEN citation_count IS NOT NULL THEN {counted} ELSE {s.impact_floor}e0 END)"


def impact(s: Settings = DEFAULT) -> str:
    a, b, c = s.impact_weights
    return clamp(f"({a}e0 * {citation_base(s)} + {b}e0 * {citation_rate(s)} + {c}e0 * {recency(s)})", s)


def boost(s: Settings = DEFAULT) -> str:
    return rules.evidence_boost(s.evidence_bonus, s.evidence_penalty, s.clinical_multiplier, s.mechanistic_penalty, s.boost_limit)


def final_score(s: Settings = DEFAULT) -> str:
    """From rel, impact, overlap, focus_overlap, entity, concept, title_entity, title_concept, anchor, title_anchor and boost."""
    extra = "(focus_overlap + 2 * entity + concept + title_entity + title_concept + anchor + title_anchor)"
    gated = f"CASE WHEN rel >= {s.relevance_gate}e0 THEN {s.alpha}e0 * impact ELSE 0e0 END"
    return f"(rel + {gated} + {s.overlap_bonus}e0 * overlap + {s.focus_bonus}e0 * {extra} + boost)"
