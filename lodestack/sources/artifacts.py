"""Evaluation artifacts and record files: ids, rows, overlays, and the JSON and text that are written from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.text import text_or_empty
from lodestack.operators import citations as C
from lodestack.sources import records

PAPER = "struct<pmid:string,title:string,year:int,journal:string,pubtypes:string,score:double,judge:struct<relevance:double>>"
ROW = (
    f"struct<question:string,answer:string,papers:array<{PAPER}>,selected_evidence_papers:array<struct<pmid:string>>,"
    "citation_status:struct<cited_pmids:array<long>>,retrieval_seconds:double,generation_seconds:double>"
)


def whole_number(c: Column | str) -> Column:
    """A string of digits as an id; anything else is null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike("^[0-9]{1,18}$"), c.try_cast("long"))


def rows_of(df: DataFrame, json: str) -> DataFrame:
    """df and n (from 0) and row of every evaluation row in a column of artifacts: an object with ``results``, or a list."""
    listed = F.coalesce(F.from_json(json, f"struct<results:array<{ROW}>>")["results"], F.from_json(json, f"array<{ROW}>"))
    return df.select(*[c for c in df.columns if c != json], F.posexplode(listed).alias("n", "row"))


def ids_in_json(df: DataFrame, json: str, id_col: str) -> DataFrame:
    """(id_col, pos, pmid): every value of a ``pmid`` field at any depth of the JSON in a text column, in the order of
    the text. Only numbers and strings of digits count. Escaped text inside strings is not mistaken for a field."""
    quiet = F.regexp_replace(F.col(json), r'\\.', "__")  # no quotes are left but those round strings
    field = r'"pmid"\s*:\s*"?\s*([0-9]{1,18})\s*(?=["\s,}\]])'
    return df.select(id_col, F.posexplode(F.regexp_extract_all(quiet, F.lit(field), 1)).alias("pos", "v")).select(id_col, "pos", F.col("v").cast("long").alias("pmid"))


def ids_in_text(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id_col, pos, pmid): all numbers of five to nine digits of a text column, repeats included."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(C.ID), 0)
    return df.select(id_col, F.posexplode(found).alias("pos", "v")).select(id_col, "pos", F.col("v").cast("long").alias("pmid"))


def distinct_ids(df: DataFrame, pos: str = "pos", group: str | None = None) -> DataFrame:
    """Ids once, by first position (within each group, if given)."""
    return df.groupBy(*[g for g in (group,) if g], "pmid").agg(F.min(pos).alias("pos"))


def select_row(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (question_id, question) asked, the artifact row it means: the first of that text (trimmed, lower case),
    else the only one that contains it. status is ``exact``, ``contains``, ``ambiguous`` or ``missing``; only the first
    two have a row. A null question means the only row. rows: n and row; the rows of one artifact are broadcast."""
    key = lambda c: F.lower(F.trim(text_or_empty(c)))
    q = asked.select("question_id", F.col("question"), key("question").alias("k"))
    r = rows.select("n", "row", key(F.col("row.question")).alias("rk"))
    met = q.join(r, F.col("question").isNull() | F.contains(F.col("rk"), F.col("k")), "left")
    exact = (F.col("rk") == F.col("k")) & F.col("question").isNotNull()
    best = met.groupBy("question_id").agg(F.min_by("row", F.when(exact, F.col("n"))).alias("same"), F.min_by("row", "n").alias("first"), F.count("n").alias("found"))
    status = F.when(F.col("same").isNotNull(), "exact").when(F.col("found") == 1, "contains").when(F.col("found") == 0, "missing").otherwise("ambiguous")
    return best.select("question_id", status.alias("status"), F.coalesce("same", F.when(F.col("found") == 1, F.col("first"))).alias("row"))


def row_ids(rows: DataFrame, use: str, row: str = "row") -> DataFrame:
    """rows plus ids: of each evaluation row the cited ids (``use`` "cited": those recorded, or without any those in the
    answer's brackets) or the retrieved ones in order."""
    recorded = F.nullif(F.coalesce(F.col(f"{row}.citation_status.cited_pmids"), F.array().cast("array<long>")), F.array().cast("array<long>"))
    cited = F.coalesce(recorded, C.cited_ids(F.col(f"{row}.answer")))
    got = F.filter(F.transform(F.coalesce(F.col(f"{row}.papers"), F.array().cast(f"array<{PAPER}>")), lambda p: whole_number(p["pmid"])), lambda x: x.isNotNull())
    return rows.withColumn("ids", cited if use == "cited" else got)


def valid_ids(row: str = "row") -> Column:
    """Ids that an answer may cite: the retrieved papers and the selected ones."""
    ids = lambda c: F.transform(F.coalesce(F.col(f"{row}.{c}.pmid"), F.array().cast("array<string>")), whole_number)
    return F.array_sort(F.array_compact(F.array_union(ids("papers"), ids("selected_evidence_papers"))))


def overlay(local: DataFrame, fetched: DataFrame, key: str = "pmid") -> DataFrame:
    """Records of either side; where both have the id, every field of the fetched one, even if it is empty."""
    fields = [c for c in local.columns if c != key]
    side = fetched.select(key, F.struct(*[F.col(c) if c in fetched.columns else F.lit(None).alias(c) for c in fields]).alias("_f"))
    met = local.withColumn("_l", F.struct(*fields)).select(key, "_l").join(side, key, "full")
    return met.select(key, *[F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(f"_l.{c}")).alias(c) for c in fields])


def incomplete(ids: DataFrame, local: DataFrame, require_abstract: bool = False) -> DataFrame:
    """The ids (pmid, pos) whose local record is missing or has no title (or abstract, if that is required)."""
    blank = lambda c: text_or_empty(c) == ""
    met = ids.join(local.select("pmid", "title", "abstract"), "pmid", "left")
    return met.where(blank("title") | (blank("abstract") if require_abstract else F.lit(False))).select("pmid", "pos")


def load_papers(ids: DataFrame, local: DataFrame, fetched: DataFrame, require_abstract: bool = False) -> DataFrame:
    """The records of ids (pmid, pos) that have a title or an abstract, with the pos of the first mention. Of the ids that
    are :func:`incomplete` the fetched record, if there is one, overlays the local one; of repeated fetched ids the
    caller decides beforehand. fetched stands for a service: any frame of records, a file source for instance."""
    once = distinct_ids(ids)
    wanted = incomplete(once, local, require_abstract)
    own = local.join(once.select("pmid"), "pmid", "left_semi")
    new = fetched.join(wanted.select("pmid"), "pmid", "left_semi")
    kept = overlay(own, new).where((text_or_empty("title") != "") | (text_or_empty("abstract") != ""))
    return kept.join(once, "pmid")


def without_citations(ids: DataFrame, citations: DataFrame) -> DataFrame:
    """The distinct ids that have no citation record."""
    return ids.select("pmid").distinct().join(citations.select("pmid"), "pmid", "left_anti")


def read_record_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Paper or citation records of a file in place of a service: ``xml`` (articles), ``json`` (one citation object a
    line, or a list: pmid, citation_count, relative_citation_ratio) or ``parquet``."""
    if kind == "xml":
        return records.read_articles(spark, path)
    if kind == "json":
        raw = spark.read.schema("pmid long, citation_count int, relative_citation_ratio double").json(path, multiLine=False)
        return raw.where("pmid is not null").select("pmid", "citation_count", F.col("relative_citation_ratio").alias("rcr"))
    return spark.read.parquet(path)


def batches(ids: DataFrame, size: int) -> DataFrame:
    """ids (pmid, pos) as requests of ``size`` ids each: batch, pmids. Numbered within ranges of pos, so no sort in one
    place; the last request of a range may be smaller."""
    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        for part in rows:
            held += part.pmid.tolist()
            while len(held) >= size:
                yield pd.DataFrame({"pmids": [held[:size]]})
                held = held[size:]
        if held:
            yield pd.DataFrame({"pmids": [held]})

    packed = distinct_ids(ids).repartitionByRange("pos").sortWithinPartitions("pos").select("pmid").mapInPandas(pack, "pmids array<long>")
    return packed.withColumn("batch", F.monotonically_increasing_id()).select("batch", "pmids")


def as_artifact(runs: DataFrame) -> DataFrame:
    """One JSON object a question from flat rows (question_id, question, pos, pmid, title, year, score, answer): question,
    answer, papers in order, n_results. A question's papers are bounded by the retrieval depth."""
    paper = F.struct("pos", F.struct("pmid", "title", "year", "score").alias("p"))
    rows = runs.groupBy("question_id", "question").agg(F.max("answer").alias("answer"), F.array_sort(F.collect_list(paper)).alias("x"))
    return rows.select("question_id", F.to_json(F.struct("question", "answer", F.transform("x", lambda v: v["p"]).alias("papers"), F.size("x").alias("n_results"))).alias("json"))


def evidence_notes(papers: DataFrame, notes: DataFrame, topic: Column) -> DataFrame:
    """One JSON object a question: topic, paper_count, notes (pmid, title, year, journal, pubtypes, note) in order of pos.
    papers: question_id, pos and a paper's columns; notes: question_id, pmid, note."""
    note = F.struct("pmid", "title", "year", "journal", "pubtypes", "note")
    met = papers.join(notes, ["question_id", "pmid"])
    rows = met.groupBy("question_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("pos"), note.alias("x")))).alias("x"))
    return rows.select("question_id", F.to_json(F.struct(topic.alias("topic"), F.col("n").alias("paper_count"), F.transform("x", lambda v: v["x"]).alias("notes"))).alias("json"))


def decimals(c: Column | str, digits: int = 2) -> Column:
    """A number as text, halves to the even digit, null as n/a."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string(f"%.{digits}f", F.bround(c, digits)))


def signed(c: Column | str, unit: str = "") -> Column:
    """A difference with its sign and two decimals, null as n/a."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.concat(F.when(c >= 0, "+").otherwise(""), F.format_string("%.2f", F.bround(c, 2)), F.lit(unit)))


def excerpt(c: Column | str, chars: int) -> Column:
    """Text on one line, cut after ``chars`` characters."""
    flat = F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars)), F.lit("…")))


def report_lines(audit: DataFrame, flagged: DataFrame) -> DataFrame:
    """The lines of a citation report in Markdown (section, question_id, n, line): a table row a question, then each
    question's papers to review."""
    cells = F.array(F.col("question_id").cast("string"), decimals("median_citations", 1), decimals("median_impact"), F.col("low_cited").cast("string"), F.col("low_impact").cast("string"), F.col("best_pmid").cast("string"))
    rows = audit.select(F.lit(1).alias("section"), "question_id", F.lit(0).alias("n"), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))
    item = F.concat(F.lit("- `"), F.col("pmid").cast("string"), F.lit("` impact_score="), decimals("impact"), F.lit(" cites="), F.coalesce(F.col("citation_count").cast("string"), F.lit("n/a")))
    return rows.unionByName(flagged.select(F.lit(2).alias("section"), "question_id", F.col("nth").alias("n"), item.alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order of section, question and number, as text files that sort by name."""
    lines.repartitionByRange("section", "question_id", "n").sortWithinPartitions("section", "question_id", "n").select("line").write.mode("overwrite").text(path)


def chunk_ids(spark: SparkSession, wanted: str, last: int = 37) -> DataFrame:
    """Chunk numbers from ``all``, a list ``1,5,9`` or a range ``5-9`` (either way round), in that order; numbers beyond
    0..last are an error."""
    if wanted == "all":
        found = list(range(last + 1))
    else:
        found = []
        for part in wanted.split(","):
            ends = [int(x) for x in part.split("-")]
            low, high = min(ends[0], ends[-1]), max(ends[0], ends[-1])
            found += range(low, high + 1)
    if bad := [n for n in found if not 0 <= n <= last]:
        raise ValueError(f"no such chunks: {bad}")
    rows = ", ".join(f"({i}, {n})" for i, n in enumerate(dict.fromkeys(found)))
    return spark.sql(f"SELECT CAST(col1 AS INT) AS pos, CAST(col2 AS INT) AS chunk FROM VALUES {rows}")


def numbered(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
