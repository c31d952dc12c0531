"""Scalar operators on edge cases, against values worked out by hand or in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestack.config import DEFAULT
from lodestack.functions import rules, scoring
from lodestack.functions import text as T
from lodestack.functions.udfs import bracket_ids, ratio
from lodestack.operators import citations as C


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*cols).select((F.expr(expr) if isinstance(expr, str) else expr).alias("r")).first().r


def test_query_terms(spark):
    q = lambda s: one(spark, T.query_terms(F.lit(s)))
    assert q("Does p53 or IL6 reduce GLP-1 risk in vitamin D?") == ["p53", "il6", "vitamin"]
    assert q("the and for") == [] and q("") == [] and q(None) == []
    assert one(spark, T.expand_aliases(T.query_terms(F.lit("pdcd1 and tp53 study p53")))) == ["pd1", "pdcd1", "p53", "tp53"]


def test_entities_phrases_and_anchors(spark):
    focus = T.focus_terms(F.lit("PD-1 blockade"))
    assert one(spark, T.entity_groups(F.lit("PD-1 blockade"), focus)) == [["pd1", "pd 1", "pd-1", "pdcd1"]]
    assert one(spark, T.required_phrases(F.lit("Vitamin D3 and vitamin  k"), F.array().cast("array<string>"))) == ["vitamin d3", "vitamin k"]
    assert one(spark, T.anchor_terms(F.lit("treatment of migraine migraine aura"))) == ["migraine", "aura"]
    assert one(spark, T.phrase_present(F.lit("A Vitamin-D trial"), F.lit("vitamin d"))) and not one(spark, T.phrase_present(F.lit("vitamin dx"), F.lit("vitamin d")))
    assert not one(spark, T.phrase_present(F.lit("x"), F.lit("")))


def test_retrieval_query(spark):
    q = lambda s: one(spark, T.retrieval_query(F.lit(s)))
    assert q(" p53 mutation ") == "p53 mutation"
    assert q("ginger for nausea") == "ginger for nausea randomized trial systematic review meta-analysis"
    assert q("treatment").startswith("treatment management guideline")
    assert "CINV antiemetic treatment" in q("chemotherapy vomiting")


def plain_age(year):
    return None if year is None or not 1800 <= year <= 2027 else max(0.5, 2026 - year + 1)


@pytest.mark.parametrize("year", [1799, 1800, 2020, 2026, 2027, 2028, None])
@pytest.mark.parametrize(("count", "rcr"), [(None, None), (0, None), (1000, 0.0), (40, 1.0), (None, 2.5)])
def test_impact(spark, year, count, rcr):
    age = plain_age(year)
    recency = 0.1 if age is None else max(0.1, min(1, math.exp(-age / 8)))
    rate = 0.1 if count is None else max(0.1, min(1, math.log1p(count / (age or 1)) / math.log1p(25)))
    base = 1 / (1 + math.exp(-(rcr - 1))) if rcr is not None else 0.1 if count is None else max(0.1, min(1, math.log1p(count) / math.log1p(1000)))
    want = max(0.1, min(1, 0.55 * base + 0.3 * rate + 0.15 * recency))
    row = spark.range(1).select(F.lit(year).cast("int").alias("year"), F.lit(count).cast("int").alias("citation_count"), F.lit(rcr).cast("double").alias("rcr"))
    got = row.select(F.expr(scoring.recency()).alias("a"), F.expr(scoring.citation_rate()).alias("b"), F.expr(scoring.impact()).alias("c")).first()
    assert (got.a, got.b, got.c) == (pytest.approx(recency), pytest.approx(rate), pytest.approx(want))


@pytest.mark.parametrize(("text", "clinical", "want"), [("systematic review of x", False, 0.07), ("systematic review of x", True, 0.14), ("randomized meta-analysis review", True, 0.15), ("in mice", True, -0.06), ("in mice", False, 0.0), ("case report", True, -0.036), ("", True, 0.0)])
def test_boost(spark, text, clinical, want):
    assert one(spark, scoring.boost(), ev=text, clinical=clinical) == pytest.approx(want)


@pytest.mark.parametrize(("title", "pub", "want"), [("consensus", "", "guideline_or_consensus"), ("x", "meta-analysis", "meta_analysis"), ("a systematic review", "", "systematic_review"), ("randomised x", "", "randomized_trial"), ("cohort", "", "cohort"), ("case control", "", "case_control"), ("overview and review", "", "review"), ("rate of x", "editorial", "mechanistic"), ("x", "news", "editorial"), ("x", "", "other")])
def test_tiers(spark, title, pub, want):
    assert one(spark, rules.TIER, title=title, pub=pub, t=f"{title}  {pub}") == want


@pytest.mark.parametrize(("q", "want"), [("", "general_clinical"), ("mortality and prevention", "clinical_management,clinical_outcomes,risk_prevention"), ("survival", "prognosis_survival"), ("chemo emesis", "cinv_management,clinical_outcomes"), ("kinase activation", "mechanism")])
def test_intents(spark, q, want):
    assert one(spark, rules.INTENT_LIST, q=q) == want


def test_citations(spark):
    text = "x [123456, 99] [PMID:1234567] (35546664) 20202020 1234567890 [12345"
    assert one(spark, C.cited_ids(F.lit(text))) == [123456, 1234567]
    assert one(spark, C.unbracketed_ids(F.lit(text))) == [12345, 20202020, 35546664]
    assert bracket_ids("see (PMID: 35546664), PMID 35546664; 35546664 and [35546664] or 355466640", [35546664]) == "see [35546664], [35546664]; [35546664] and [35546664] or 355466640"
    df = spark.createDataFrame([("a (11111) 22222 [33333]", [11111])], "answer string, valid_ids array<long>")
    out = C.validate(df).first().answer
    assert out.startswith("a [11111] 22222 [33333]") and re.findall(r"(NOTE|WARNING): (\S+)", out) == [("NOTE", "normalized"), ("WARNING", "PMID-like"), ("WARNING", "cited")]


def test_ratio():
    assert ratio("", "x") == 0.0 and ratio("abc", "abc") == 1.0 and 0.6 < ratio("abcd", "abce") < 0.9
    assert DEFAULT.title_ratio == 0.92
