"""Ids cited in generated answers, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import text_or_empty
from lodestack.functions.udfs import normalize_ids

ID = r"\b[0-9]{5,9}\b"


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ID), 0), lambda x: x.cast("long"))


def ids_anywhere(text: Column | str) -> Column:
    """Distinct numbers of five to nine digits, in order of value."""
    return F.array_sort(F.array_distinct(_numbers(text_or_empty(text))))


def cited_ids(text: Column | str) -> Column:
    """Ids inside square brackets."""
    inside = F.regexp_extract_all(text_or_empty(text), F.lit(r"\[([^\]]+)\]"), 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(inside, _numbers))))


def unbracketed_ids(text: Column | str) -> Column:
    """Ids outside square brackets; a bracket separates like a line break."""
    return ids_anywhere(F.regexp_replace(text_or_empty(text), r"\[[^\]]*\]", "\n"))


def invalid_ids(cited: Column, valid: Column) -> Column:
    return F.array_sort(F.array_except(cited, valid))


def citation_status(answers: DataFrame, text: str = "answer", valid: str = "valid_ids") -> DataFrame:
    """Adds cited, anywhere, unbracketed, invalid_cited, invalid_anywhere and the flags format_warning,
    validation_warning and normalization_note (notes that a validation step left in the text)."""
    noted = lambda s: F.contains(text_or_empty(text), F.lit(s))
    out = answers.withColumns({"cited": cited_ids(text), "anywhere": ids_anywhere(text), "unbracketed": unbracketed_ids(text)})
    return out.withColumns({
        "invalid_cited": invalid_ids(F.col("cited"), F.col(valid)), "invalid_anywhere": invalid_ids(F.col("anywhere"), F.col(valid)),
        "format_warning": noted("not in [PMID] citation format") & noted("WARNING"), "validation_warning": noted("cited PMIDs not in the retrieved"),
        "normalization_note": noted("NOTE: normalized retrieved PMIDs"),
    })


def validate(answers: DataFrame, text: str = "answer", valid: str = "valid_ids") -> DataFrame:
    """Puts valid ids into brackets and appends notes: what was normalised, what still stands bare, what is unknown."""
    shown = lambda ids: F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))
    out = answers.withColumn("_bare", F.array_sort(F.array_intersect(unbracketed_ids(text), F.col(valid))))
    out = out.withColumn(text, F.when(F.size(valid) > 0, normalize_ids(text_or_empty(text), F.col(valid))).otherwise(text_or_empty(text)))
    left, unknown = unbracketed_ids(text), invalid_ids(cited_ids(text), F.col(valid))
    head = "\n\n[citation-validation] "
    note = lambda ids, words: F.when(F.size(ids) > 0, F.concat(F.lit(head + words), shown(ids))).otherwise("")
    notes = F.concat(
        note(F.col("_bare"), "NOTE: normalized retrieved PMIDs that were not in [PMID] citation format: "),
        note(left, "WARNING: PMID-like numbers not in [PMID] citation format: "),
        note(unknown, "WARNING: cited PMIDs not in the retrieved set (possible hallucination): "),
    )
    return out.withColumn(text, F.concat(F.col(text), notes)).drop("_bare")
