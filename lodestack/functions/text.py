"""Text and query analysis as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions import lexicon as L

TOKEN = "[a-z0-9]+"


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(TOKEN), 0)


def words(*terms: str) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def content_text(title: Column | str, abstract: Column | str) -> Column:
    return F.lower(F.trim(F.concat_ws(" ", text_or_empty(title), text_or_empty(abstract))))


def symbol(t: Column) -> Column:
    """A short symbol such as p53 or il6."""
    return (F.length(t) >= 2) & t.rlike("[a-z]") & t.rlike("[0-9]")


def query_terms(q: Column | str) -> Column:
    """Tokens longer than three characters and symbols, without stopwords; repeats stay."""
    return F.filter(tokens(q), lambda t: ((F.length(t) > 3) | symbol(t)) & ~t.isin(L.STOPWORDS))


def compact(name: str) -> str:
    return "".join(c for c in name if c.isalnum())


def expand_aliases(terms: Column) -> Column:
    """Each entity name replaced by all names of its group in compact form; distinct, in order."""

    def names(t: Column) -> Column:
        out = F.array(t)
        for group in L.ENTITIES:
            flat = list(dict.fromkeys(compact(a) for a in group))
            out = F.when(t.isin(flat), words(*flat)).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(terms, names)))


def phrase_key(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def phrase_present(text: Column | str, phrase: Column | str) -> Column:
    """Whether the phrase's tokens stand in the text in a row; false for an empty phrase."""
    key = phrase_key(phrase)
    padded = lambda k: F.concat(F.lit(" "), k, F.lit(" "))
    return (key != "") & F.contains(padded(phrase_key(text)), padded(key))


def norm_title(c: Column | str) -> Column:
    return phrase_key(c)


def title_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 2))


def overlap_count(text: Column, terms: Column) -> Column:
    """Terms that are substrings of the text; repeats count again."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def focus_terms(q: Column | str) -> Column:
    """The first two tokens longer than three characters that are no stopwords."""
    return F.slice(F.filter(tokens(q), lambda t: (F.length(t) > 3) & ~t.isin(L.FOCUS_STOPWORDS)), 1, 2)


def required_phrases(q: Column | str, focus: Column) -> Column:
    """Every ``vitamin x`` of the question, and of the focus terms."""
    named = F.transform(F.regexp_extract_all(F.lower(text_or_empty(q)), F.lit(r"\bvitamin\s+([a-z0-9]+)\b"), 1), lambda x: F.concat(F.lit("vitamin "), x))
    focused = F.filter(focus, lambda t: F.lower(t).rlike(r"^vitamin\s+[a-z0-9]+$"))
    return F.concat(named, F.array_except(F.transform(focused, lambda t: F.lower(t)), named))


def entity_groups(q: Column | str, focus: Column) -> Column:
    """Groups of entity names (array of arrays) of which the question or focus holds one."""
    text = F.concat_ws(" ", text_or_empty(q), F.array_join(focus, " "))
    own = tokens(text)
    found = []
    for group in L.ENTITIES:
        flat = sorted({compact(a) for a in group})
        held = F.arrays_overlap(own, words(*flat))
        for name in group:
            held = held | phrase_present(text, F.lit(name))
        found.append(F.when(held, words(*group)))
    return F.filter(F.array(*found), lambda g: g.isNotNull())


def concept_groups(q: Column | str) -> Column:
    """The prognosis stems as one group when the question asks for a prognosis."""
    asked = F.lower(text_or_empty(q)).rlike(r"(?U)\bprognos(?:is|tic)?\b")
    return F.when(asked, F.array(words(*L.PROGNOSIS_STEMS))).otherwise(F.array().cast("array<array<string>>"))


def anchor_terms(q: Column | str) -> Column:
    return F.array_distinct(F.filter(query_terms(q), lambda t: ~t.isin(L.GENERIC)))


def anchor_least(anchors: Column) -> Column:
    return F.least(F.size(anchors), F.lit(2))


def groups_present(text: Column, groups: Column, whole: bool) -> Column:
    """How many groups have a member in the text: as a phrase of whole tokens, or as a substring."""
    member = (lambda t: phrase_present(text, t)) if whole else (lambda t: F.contains(text, t))
    return F.size(F.filter(groups, lambda g: F.exists(g, member)))


def retrieval_query(q: Column | str) -> Column:
    """A management question with its expansion terms; other questions trimmed."""
    own = F.trim(text_or_empty(q))
    low = F.lower(own)
    cinv = F.when(low.rlike("(?U)" + L.CINV_PATTERN), words(*L.CINV_EXPANSION)).otherwise(F.array().cast("array<string>"))
    adds = F.when(any_of(low, L.ADJUNCTIVE_QUERY), words(*L.ADJUNCTIVE_EXPANSION)).otherwise(F.concat(cinv, words(*L.EXPANSION)))
    seen = F.regexp_extract_all(low, F.lit("[a-z0-9]+(?: [a-z0-9]+)*"), 0)
    new = F.array_distinct(F.filter(adds, lambda a: ~F.array_contains(seen, F.lower(a))))
    return F.when(any_of(low, L.MANAGEMENT_QUERY), F.concat_ws(" ", own, F.array_join(new, " "))).otherwise(own)


def any_of(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def with_rule_columns(papers, question: str = "question"):
    """Adds the columns that :mod:`lodestack.functions.rules` reads: q, title and pub in lower case, t and ev."""
    low = lambda c: F.lower(text_or_empty(c))
    return papers.withColumns({
        "q": low(question) if question in papers.columns else F.lit(""),
        "t": F.lower(F.concat(text_or_empty("title"), F.lit(" "), text_or_empty("abstract"), F.lit(" "), text_or_empty("pubtypes"))),
        "ev": F.lower(F.concat(text_or_empty("pubtypes"), F.lit(" "), text_or_empty("title"))),
        "pub": low("pubtypes"),
        "raw_title": F.col("title"),
    }).withColumn("title", low("title"))
