"""Line dedup by winnowing over line hashes, in DataFrame expressions only.

The non-blank lines of a document are hashed; of every ``window`` neighbouring hashes the smallest (the rightmost, if
there are several) is a fingerprint, so any run of ``window`` lines that two documents share has a fingerprint in
common, in both at the same line of the run. The sequence is padded at both ends, so first and last lines always are
fingerprints. Lines of ``least_words`` or more are worth deleting alone, so each of them is a fingerprint too: for them
the window is one line. Matching fingerprints are extended both ways: fewer than ``window`` lines lie between a run's outermost
fingerprint and its end, so a fingerprint carries the hashes of that many lines on either side, and each extension
by 0, 1, ... lines is a key of its own (but for those that reach a line with a key of its own). The first place of each key, by document and line, is kept; the line that a
later place reaches is part of a later repeated run. Such a run is deleted if it has two lines or ``least_words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint, hot_lookup

BLANKS = " \t\r\x0b\x0c"


def line_hash(line: Column) -> Column:
    """60 bits of the MD5 of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def keyed_runs(docs: DataFrame, window: int, least_words: int) -> DataFrame:
    """From (doc_id, doc_hash, text) one row for each fingerprint and extension: key, at (line of the fingerprint),
    line, row (number in the text) and words of the line it reaches. Lines are counted without the blank ones."""
    raw = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = F.filter(F.transform(raw, lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("t"), i.alias("row"))), lambda x: x["t"] != "")
    seq = F.transform(lines, lambda x: F.struct(line_hash(x["t"]).alias("h"), x["row"].alias("row"), F.size(F.split(x["t"], "[ \\t]+")).alias("words")))
    reach = window - 1

    def place(x: Column, j: Column) -> Column:
        hs = F.col("hs")
        left = F.slice(hs, F.greatest(j + 1 - reach, F.lit(1)), F.least(j, F.lit(reach)))
        right = F.slice(hs, j + 2, F.lit(reach))
        return F.struct(x["h"].alias("h"), j.alias("j"), (x["words"] >= least_words).alias("long"), left.alias("left"), right.alias("right"))

    def short(j: Column) -> Column:
        return F.get("seq", j)["words"] < least_words

    def chosen(x: Column) -> Column:
        picked = x["long"]
        for b in range(window):  # the window that has b lines before this one
            before = F.slice(x["left"], F.greatest(F.size(x["left"]) - b + 1, F.lit(1)), F.lit(b))
            after = F.slice(x["right"], 1, reach - b)
            picked = picked | (F.forall(before, lambda y: y >= x["h"]) & F.forall(after, lambda y: y > x["h"]))
        return picked

    def extensions(x: Column) -> Column:
        own = F.struct(F.xxhash64(F.lit(0), x["h"]).alias("key"), x["j"].cast("int").alias("at"), x["j"].cast("int").alias("line"))
        made = [own]
        for r in range(1, window):
            back = F.slice(x["left"], F.greatest(F.size(x["left"]) - r + 1, F.lit(1)), F.lit(r))
            made += [
                F.when((F.size(x["left"]) >= r) & short(x["j"] - r), F.struct(F.xxhash64(F.lit(-r), x["h"], back).alias("key"), x["j"].cast("int").alias("at"), (x["j"] - r).cast("int").alias("line"))),
                F.when((F.size(x["right"]) >= r) & short(x["j"] + r), F.struct(F.xxhash64(F.lit(r), x["h"], F.slice(x["right"], 1, r)).alias("key"), x["j"].cast("int").alias("at"), (x["j"] + r).cast("int").alias("line"))),
            ]
        return F.filter(F.array(*made), lambda y: y.isNotNull())

    at = docs.select("doc_id", "doc_hash", seq.alias("seq")).withColumn("hs", F.transform("seq", lambda x: x["h"]))
    marked = F.filter(F.transform("seq", place), chosen)
    out = at.select("doc_id", "doc_hash", "seq", F.explode(F.flatten(F.transform(marked, extensions))).alias("e"))
    reached = F.get("seq", F.col("e.line"))
    return out.select("e.key", "doc_id", "doc_hash", "e.at", "e.line", reached["row"].alias("row"), reached["words"].alias("words"))


def repeated_lines(docs: DataFrame, window: int, least_words: int) -> DataFrame:
    """One row a document that has later repeated runs: doc_id, doc_hash, rows (numbers of the lines to delete)."""
    keyed = checkpoint(keyed_runs(docs, window, least_words))
    place = F.struct("doc_id", "doc_hash", "at")
    first = keyed.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    later = hot_lookup(keyed, checkpoint(first), "key", "_n", keyed.count()).filter(F.col("first").isNotNull())
    later = later.filter(~place.eqNullSafe(F.col("first")))
    runs = later.groupBy("doc_id", "doc_hash").agg(F.array_sort(F.collect_set(F.struct("line", "row", "words"))).alias("run"))

    def goes(x: Column, i: Column) -> Column:
        beside = lambda k: F.coalesce(F.get("run", i + k)["line"] == x["line"] + k, F.lit(False))
        return (x["words"] >= least_words) | beside(-1) | beside(1)

    rows = F.transform(F.filter("run", goes), lambda x: x["row"])
    return runs.select("doc_id", "doc_hash", rows.alias("rows")).filter(F.size("rows") > 0)


def dedup_lines(docs: DataFrame, window: int = 2, least_words: int = 5) -> DataFrame:
    """docs with the later repeated runs of lines cut out of text, plus n_lines and n_deleted (int).

    Every later line of ``least_words`` words or more goes, and every later run of ``window`` lines or more.
    Lines compare without white space at their ends; blank lines never match and stay. The first place of a run is
    the one of the smallest doc_id (null first), then text hash and line; rows of one id and text count as one
    document and stay alike. A document may lose all its lines: its text is then empty. Null text stays null and
    counts no line. Columns besides doc_id and text pass through; n_lines and n_deleted replace any of that name.
    """
    docs = docs.drop("n_lines", "n_deleted")
    own = docs.withColumn("_kept", F.col("doc_hash")) if "doc_hash" in docs.columns else docs
    own = own.withColumn("doc_hash", line_hash(F.coalesce("text", F.lit(""))))
    gone = repeated_lines(own.select("doc_id", "doc_hash", "text"), window, least_words)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), "rows")
    met = own.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_hash") == F.col("_hash")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("rows"))
    text = F.when(F.col("rows").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    met = met.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    met = met.withColumn("n_deleted", F.coalesce(F.size("rows"), F.lit(0))).withColumn("text", text)
    hidden = F.col("_kept").alias("doc_hash") if "_kept" in met.columns else None
    return met.select(*[hidden if c == "doc_hash" else F.col(c) for c in docs.columns], "n_lines", "n_deleted")


def op4(docs: DataFrame) -> DataFrame:
    """What line dedup leaves of each document: doc_id, n_lines, n_deleted, n_chars and text_md5 of the new text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


OP4_SQL = r"""
WITH raw AS (
  SELECT DISTINCT doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS dh, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT doc_id, dh, unnest(string_split(coalesce(text, ''), chr(10))) AS raw_line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS rn FROM raw
), kept AS (
  SELECT doc_id, dh, rn, trim(raw_line, e' \t\r\x0b\x0c') AS t FROM split WHERE trim(raw_line, e' \t\r\x0b\x0c') <> ''
), seq AS (
  SELECT doc_id, dh, rn, t, ('0x' || substr(md5(t), 1, 15))::BIGINT AS h, len(regexp_split_to_array(t, '[ \t]+')) AS words,
    row_number() OVER (PARTITION BY doc_id, dh ORDER BY rn) AS j FROM kept
), ctx AS (
  SELECT *, lag(h) OVER w AS p, lead(h) OVER w AS n FROM seq WINDOW w AS (PARTITION BY doc_id, dh ORDER BY j)
), fp AS (
  SELECT * FROM ctx WHERE words >= 5 OR n IS NULL OR n > h OR p IS NULL OR p >= h
), keyed AS (
  SELECT doc_id, dh, j AS spot, j AS line, 'o' || h AS key FROM fp
  UNION ALL SELECT doc_id, dh, j, j - 1, 'p' || p || ',' || h FROM fp WHERE p IS NOT NULL
  UNION ALL SELECT doc_id, dh, j, j + 1, 'n' || h || ',' || n FROM fp WHERE n IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, dh, spot) AS nth FROM keyed
), later AS (
  SELECT DISTINCT doc_id, dh, line FROM placed WHERE nth > 1
), found AS (
  SELECT s.doc_id, s.dh, s.rn, s.words, s.j, lag(s.j) OVER w AS pj, lead(s.j) OVER w AS nj
  FROM seq s JOIN later l ON s.doc_id IS NOT DISTINCT FROM l.doc_id AND s.dh = l.dh AND s.j = l.line
  WINDOW w AS (PARTITION BY s.doc_id, s.dh ORDER BY s.j)
), gone AS (
  SELECT doc_id, dh, rn FROM found WHERE words >= 5 OR pj = j - 1 OR nj = j + 1
), built AS (
  SELECT s.doc_id, s.dh, count(*) AS n_lines, count(g.rn) AS n_deleted,
    coalesce(string_agg(CASE WHEN g.rn IS NULL THEN raw_line END, chr(10) ORDER BY s.rn), '') AS new_text
  FROM split s LEFT JOIN gone g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.dh = g.dh AND s.rn = g.rn GROUP BY s.doc_id, s.dh
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE b.n_lines END AS n_lines, b.n_deleted, CAST(length(b.new_text) AS BIGINT) AS n_chars, md5(b.new_text) AS text_md5
FROM documents d JOIN built b ON d.doc_id IS NOT DISTINCT FROM b.doc_id AND b.dh = ('0x' || substr(md5(coalesce(d.text, '')), 1, 15))::BIGINT
"""
