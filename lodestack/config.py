"""Parameters of retrieval, scoring and selection."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    rrf_k: int = 60
    lexical_k: int = 100
    dense_k: int = 100
    context: int = 10
    overlap_min: int = 1
    overlap_bonus: float = 0.02
    min_chars: int = 40
    focus_min_rel: float = 0.65
    overlap_min_rel: float = 0.55
    focus_bonus: float = 0.04
    evidence_bonus: float = 0.05
    evidence_penalty: float = 0.03
    boost_limit: float = 0.15
    title_ratio: float = 0.92
    title_jaccard: float = 0.80
    quotas: tuple[int, int] = (5, 5)
    clinical_quotas: tuple[int, int] = (7, 3)
    clinical_multiplier: float = 2.0
    mechanistic_penalty: float = 0.06
    alpha: float = 0.10
    relevance_gate: float = 0.0
    impact_floor: float = 0.10
    half_life: float = 8.0
    rate_target: float = 25.0
    impact_weights: tuple[float, float, float] = (0.55, 0.30, 0.15)
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    as_of_year: int = 2026
    max_selected: int = 8
    min_selected: int = 4


DEFAULT = Settings()
