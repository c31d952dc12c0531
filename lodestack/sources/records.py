"""Reading, merging and checking paper records."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["pmid", "title", "abstract", "journal", "year", "mesh", "pubtypes", "retracted"]
PAPER = "pmid long, title string, abstract string, journal string, year int, mesh string, pubtypes string, retracted int"
ARTICLE = (
    "MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
    " Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>, PublicationTypeList:struct<PublicationType:array<string>>>,"
    " MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>>"
)


def from_articles(articles: DataFrame) -> DataFrame:
    """Paper records from parsed article elements; elements without an id or an article give none."""
    m = F.col("MedlineCitation")
    a = m["Article"]
    part = lambda x: F.when(F.length(F.trim(x["_Label"])) > 0, F.concat(x["_Label"], F.lit(": "), F.trim(x["_VALUE"]))).otherwise(F.trim(x["_VALUE"]))
    sections = F.filter(a["Abstract"]["AbstractText"], lambda x: F.length(F.trim(x["_VALUE"])) > 0)
    kinds = F.filter(F.coalesce(a["PublicationTypeList"]["PublicationType"], F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)
    mesh = F.filter(F.transform(F.coalesce(m["MeshHeadingList"]["MeshHeading"], F.array().cast("array<struct<DescriptorName:string>>")), lambda x: F.trim(x["DescriptorName"])), lambda x: F.length(x) > 0)
    year = F.trim(a["Journal"]["JournalIssue"]["PubDate"]["Year"])
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return articles.where(F.trim(m["PMID"]).rlike("^[0-9]+$") & a.isNotNull()).select(
        F.trim(m["PMID"]).cast("long").alias("pmid"), text(a["ArticleTitle"]).alias("title"),
        F.coalesce(F.array_join(F.transform(sections, part), " "), F.lit("")).alias("abstract"), text(a["Journal"]["Title"]).alias("journal"),
        F.when(year.rlike("^[0-9]+$"), year.cast("int")).alias("year"), F.array_join(mesh, "; ").alias("mesh"), F.array_join(kinds, "; ").alias("pubtypes"),
        F.exists(kinds, lambda k: F.contains(k, F.lit("Retract"))).cast("int").alias("retracted"),
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Papers from (gzipped) citation XML files; one task a gzipped file, rows streamed."""
    return from_articles(spark.read.schema(ARTICLE).format("xml").option("rowTag", "PubmedArticle").load(path))


def parse_articles(df: DataFrame, xml: str) -> DataFrame:
    """As :func:`read_articles`, from one article element in each row of a text column."""
    return from_articles(df.select(F.from_xml(F.col(xml), ARTICLE).alias("_a")).select("_a.*"))


def coerce_year(value: Column | str) -> Column:
    """The first four characters as a year of 1800..2200, else null."""
    head = F.substring((F.col(value) if isinstance(value, str) else value).cast("string"), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$") & head.try_cast("int").between(1800, 2200), head.try_cast("int"))


def text_records(df: DataFrame, json: str, id_col: str = "pmid", keep: Sequence[str] = ()) -> DataFrame:
    """Papers from JSON objects with short or long field names: t/title, a/abstract, j/journal, y/year/d/date,
    m/mesh, p/pt/pubtypes (lists joined by "; "); anything that is no object gives blanks. ``keep``: further columns."""
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{n}"), F.lit("")) for n in names], F.lit(""))
    joined = lambda c: F.when(F.startswith(c, F.lit("[")), F.array_join(F.from_json(c, "array<string>"), "; ")).otherwise(c)
    return df.select(*keep, F.col(id_col).cast("long").alias("pmid"), get("t", "title").alias("title"), get("a", "abstract").alias("abstract"), get("j", "journal").alias("journal"), coerce_year(get("y", "year", "d", "date")).alias("year"), joined(get("m", "mesh")).alias("mesh"), joined(get("pt", "pubtypes", "p")).alias("pubtypes"), (~get("retracted").isin("", "0", "0.0", "false")).cast("int").alias("retracted"))


def text_map(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, record as JSON) from a JSON file that maps ids to records."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("pmid", "record")).select(F.col("pmid").try_cast("long").alias("pmid"), "record").where("pmid is not null")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, vector) of the rows of two-dimensional .npy files, a slice at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content, strict=True):
                m = np.load(io.BytesIO(content))
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096].astype("float32")
                    yield pd.DataFrame({"path": p, "pos": np.arange(at, at + len(part)), "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, pos long, vector array<float>")


def upsert(old: DataFrame, new: DataFrame, key: str = "pmid", order: str | None = None) -> DataFrame:
    """old with the rows of new in their place by key. Of several new rows of a key the one of the largest ``order``
    wins; without an order new may have a key once only, else which of its rows wins is not defined. Rewrites all."""
    rest = [c for c in old.columns if c != key]
    turn = F.lit(1.0) if order is None else F.col(order).cast("double")
    side = lambda df, n: df.select(key, F.struct(n.alias("n"), F.struct(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in rest]).alias("x")).alias("r"))
    both = side(old, F.lit(float("-inf"))).union(side(new, F.coalesce(turn, F.lit(-1e308))))
    return both.groupBy(key).agg(F.max_by("r.x", "r.n").alias("x")).select(*[key if c == key else F.col(f"x.{c}").alias(c) for c in old.columns])


def enrich(old: DataFrame, fetched: DataFrame, replace: bool = False) -> DataFrame:
    """Fills journal, mesh, pubtypes and year from fetched records, title and abstract only where empty; the retraction
    flag is overwritten. With ``replace`` every fetched value wins."""
    f = fetched.select("pmid", *[F.col(c).alias(f"_{c}") for c in COLUMNS[1:]], F.lit(True).alias("_hit"))
    met = old.join(f, "pmid", "left")
    hit = F.col("_hit").isNotNull()
    if replace:
        return met.select("pmid", *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS[1:]])
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    made = {c: F.coalesce(full(f"_{c}"), F.col(c)) for c in ("journal", "mesh", "pubtypes")} | {c: F.coalesce(full(c), F.col(f"_{c}"), F.col(c)) for c in ("title", "abstract")}
    made |= {"year": F.coalesce("_year", "year"), "retracted": F.when(hit, F.coalesce("_retracted", "retracted")).otherwise(F.col("retracted"))}
    return met.select("pmid", *[made[c].alias(c) for c in COLUMNS[1:]])


def missing_metadata(papers: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids without journal, publication types or year; the first ``limit`` by id, if given."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    out = papers.where(blank("journal") | blank("pubtypes") | F.col("year").isNull()).select("pmid")
    return out if limit is None else out.orderBy("pmid").limit(limit)


def integrity_report(papers: DataFrame, citations: DataFrame, vectors: DataFrame, least: float = 95.0) -> DataFrame:
    """One row (check, value, status) for each count and coverage, computed from the written tables."""
    share = lambda c: F.round(100.0 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 3)
    text = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    p = papers.agg(F.count("*").cast("double").alias("papers"), F.count_distinct("pmid").cast("double").alias("distinct_ids"), share(text("title") | text("abstract")).alias("text_coverage"), share(text("abstract")).alias("abstract_coverage"), share(F.col("year").isNotNull()).alias("year_coverage"))
    c = citations.agg(F.count("*").cast("double").alias("citations"))
    v = vectors.agg(F.count("*").cast("double").alias("vectors"))
    checks = ["papers", "distinct_ids", "vectors", "citations", "text_coverage", "abstract_coverage", "year_coverage"]
    one = p.crossJoin(c).crossJoin(v)  # one row each
    ok = F.when(F.col("check") == "distinct_ids", F.col("value") == F.col("papers")).when(F.col("check").endswith("coverage"), F.col("value") >= least).otherwise(F.col("value") > 0)
    kept = one.withColumn("p", F.col("papers")).unpivot(["p"], checks, "check", "value").withColumnRenamed("p", "papers")
    return kept.select("check", "value", F.when(ok, "pass").otherwise("warn").alias("status"))


def chunk_report(papers: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Per chunk: rows, rows without text, abstract or year (0 is none), and ids that an earlier chunk has too."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    first = F.min(chunk).over(Window.partitionBy("pmid"))
    return papers.withColumn("_first", first).groupBy(chunk).agg(F.count("*").alias("rows"), F.count_if(blank("title") & blank("abstract")).alias("without_text"), F.count_if(blank("abstract")).alias("without_abstract"), F.count_if(F.coalesce("year", F.lit(0)) == 0).alias("without_year"), F.count_if(F.col("_first") < F.col(chunk)).alias("seen_before"))


def unique_ids(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct whole-number ids by first position; anything else goes."""
    ids = F.trim(F.col(value))
    return df.where(ids.rlike("^[0-9]{1,18}$")).groupBy(ids.cast("long").alias("pmid")).agg(F.min(pos).alias("pos"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question) of a text file, one a line without blank and # lines, or of a JSON list or object."""
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.from_json("value", "struct<questions:array<string>>")["questions"], F.from_json("value", "array<string>"))
        items = raw.select(F.posexplode(listed).alias("question_id", "q"))
        return items.select(F.col("question_id").cast("long"), F.coalesce(F.get_json_object("q", "$.question"), "q").alias("question"))
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("question_id", "q"))
    return raw.select(F.col("question_id").cast("long"), F.trim("q").alias("question")).where("question <> '' and not startswith(question, '#')")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows (question, pos, pmid, score, answer) of an evaluation artifact; of repeated questions the last counts."""
    paper = "array<struct<pmid:long,score:double>>"
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<results:array<struct<question:string,answer:string,papers:{paper}>>>")["results"], F.from_json("value", f"array<struct<question:string,answer:string,papers:{paper}>>")).alias("r"))
    rows = raw.select(F.posexplode("r").alias("n", "x")).groupBy("x.question").agg(F.max_by("x", "n").alias("x"))
    return rows.select("x.question", "x.answer", F.posexplode_outer("x.papers").alias("pos", "p")).select("question", "answer", (F.col("pos") + 1).alias("pos"), "p.pmid", "p.score")
