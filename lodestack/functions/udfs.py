"""The few functions that need Python: sequence ratio and rewriting by per-row patterns."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two normal titles, 0 if either is empty. Not symmetric: candidate first."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


# What stays as it is, and the forms in which a known id is put into brackets.
CITED = r"\[[^\]]*\]"
FORMS = (r"\(\s*(?:PMID\s*:?\s*)?({ids})\s*\)", r"\bPMID\s*:?\s*({ids})\b", r"(?<![\d\[])\b({ids})\b(?![\d\]])")


def bracket_ids(text: str | None, valid: list[int]) -> str:
    """Bare or parenthesised ids of ``valid`` outside square brackets put into brackets, in one pass over the text."""
    known = sorted({str(int(v)) for v in valid}, key=lambda v: (-len(v), v))
    if not text or not known:
        return text or ""
    forms = "|".join([CITED, *FORMS]).replace("{ids}", "|".join(known))

    def put(m: re.Match) -> str:
        return f"[{m[m.lastindex]}]" if m.lastindex else m[0]

    return re.sub(forms, put, text, flags=re.IGNORECASE)


@F.pandas_udf(StringType())
def normalize_ids(texts: pd.Series, valid: pd.Series) -> pd.Series:
    return pd.Series([bracket_ids(t, list(v) if v is not None else []) for t, v in zip(texts, valid, strict=True)], dtype=object)
