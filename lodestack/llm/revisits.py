"""Resolution of not-modified revisit records: an as-of join to the latest earlier full response.

A revisit (HTTP 304, or a WARC revisit with profile server-not-modified) has no body. Its body is that of the latest
earlier full response of the same canonical URL, provided that the validators it repeats agree; its headers replace
the stored ones except those that describe the stored body.

The join is a running last value over (URL, time). A URL with very many captures is cut into runs of time at its own
quantiles, so it is not one task's work; the last response before a run is carried in from a table that has one row
for each run of such a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import HOT_KEYS, HOT_LEAST, checkpoint

# Headers that describe the stored body, which a 304 must not replace (RFC 9111, 3.2), and hop-by-hop ones.
HELD = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that only track where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid|sid)"
#: Runs of time that a hot URL is cut into, and rows up to which what they carry over is broadcast.
RUNS, FEW = 256, 10_000


def canonical_url(url: Column) -> Column:
    """A comparison key: no scheme, user, ``www``, default port, fragment, tracking parameters or closing slash; lower
    case host; parameters in order of name. Null gives null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\d*\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def header(name: str, headers: str = "headers") -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def strong(tag: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted ones of the revisit in their place, by name."""
    allowed = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(*HELD))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    kept = F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return by_name(F.concat(kept, allowed))


def by_name(headers: Column) -> Column:
    return F.array_sort(F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))))


def resolve(captures: DataFrame) -> DataFrame:
    """Captures (record_id long, url, at timestamp or long, status int, digest string, headers array<struct<name,
    value>>) with what each stands for: canonical, base_id, outcome, body_digest and merged headers.

    outcome: ``full`` for a response (status 200..299; it is its own base); for a status of 304 ``resolved`` when the
    entity tag it repeats, or without one the Last-Modified date, equals the base's; ``unverified`` when it repeats
    neither; ``mismatch`` when it differs (or the base has none), and ``orphan`` when no full response is earlier, both
    without a body; ``other`` for the rest. Earlier means a smaller ``at``; of several full responses at one time the
    one of the largest record_id counts. A null url or time resolves nothing (orphan). Repeated rows keep their rows;
    an empty table gives no rows; null headers are no headers. Further columns are not returned.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("canonical"), "at", "status", "digest", F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"))
    full = F.col("status").between(200, 299)
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)))
    sizes = checkpoint(rows.groupBy("canonical").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter((F.col("n") > max(HOT_LEAST, total // HOT_KEYS)) & F.col("canonical").isNotNull()).select("canonical")  # at most HOT_KEYS
    order = F.col("at").cast("double")
    cuts = rows.join(F.broadcast(hot), "canonical").groupBy("canonical").agg(F.percentile_approx(order, [i / RUNS for i in range(1, RUNS)], 10 * RUNS).alias("cuts"))
    cuts = checkpoint(cuts)
    run = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c < order)))
    spread = F.when(F.col("canonical").isNull() | F.col("at").isNull(), F.pmod(F.xxhash64("record_id", "digest"), F.lit(1024))).otherwise(0)
    rows = rows.join(F.broadcast(cuts), "canonical", "left").withColumn("run", run.cast("int")).withColumn("spread", spread)
    rows = checkpoint(rows.withColumn("hot", F.col("cuts").isNotNull()).drop("cuts"))

    base = F.struct(F.col("record_id").alias("id"), "digest", strong(header("etag")).alias("etag"), header("last-modified").alias("modified"), "headers")
    last = rows.filter(F.col("hot") & F.col("full") & F.col("at").isNotNull()).groupBy("canonical", "run").agg(F.max_by(base, F.struct("at", "record_id")).alias("base"))
    runs = rows.filter("hot").select("canonical", "run").distinct()
    back = Window.partitionBy("canonical").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.join(last, ["canonical", "run"], "left").withColumn("carried", F.last("base", ignorenulls=True).over(back)).select("canonical", "run", "carried")
    carried = checkpoint(carried.filter("carried is not null"))  # at most HOT_KEYS * RUNS rows, each with its headers
    carried = F.broadcast(carried) if carried.count() <= FEW else carried
    before = Window.partitionBy("canonical", "run", "spread").orderBy(F.col("at"), F.col("full"), F.col("record_id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_base", F.last(F.when(F.col("full") & F.col("at").isNotNull(), base), ignorenulls=True).over(before))
    met = rows.join(carried, ["canonical", "run"], "left")
    base = F.when(F.col("canonical").isNotNull() & F.col("at").isNotNull(), F.coalesce("_base", "carried"))
    met = met.withColumn("base", base).withColumn("etag", strong(header("etag"))).withColumn("modified", header("last-modified"))
    agrees = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("base.etag")).when(F.col("modified").isNotNull(), F.col("modified") == F.col("base.modified"))
    outcome = (
        F.when(F.col("full"), "full")
        .when(F.coalesce(F.col("status") != 304, F.lit(True)), "other")
        .when(F.col("base").isNull(), "orphan")
        .when(F.col("etag").isNull() & F.col("modified").isNull(), "unverified")
        .when(F.coalesce(agrees, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    met = met.withColumn("outcome", outcome)
    found = F.col("outcome").isin("resolved", "unverified")
    return met.select(
        "record_id", "canonical", "at", "outcome",
        F.when(F.col("full"), F.col("record_id")).when(found, F.col("base.id")).alias("base_id"),
        F.when(F.col("full"), F.col("digest")).when(found, F.col("base.digest")).alias("body_digest"),
        F.when(found, merged_headers(F.col("base.headers"), F.col("headers"))).otherwise(by_name(F.col("headers"))).alias("headers"),
    )


def pages_as_captures(pages: DataFrame) -> DataFrame:
    """A crawl log made from a table of pages: every page is fetched in full at second 3 * page_id, and revisited with
    a 304 at 3 * page_id + 7 + page_id mod 4, with the tag, only the date, neither, or a wrong tag, in turn. One page
    in eleven is not fetched in full, so some revisits find an earlier capture of their URL or nothing."""
    def headers(*pairs: tuple[str, Column]) -> Column:
        made = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])
        return F.filter(made, lambda h: h["value"].isNotNull())

    i, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    tag, date = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')), F.concat(F.lit("day "), (i % 1000).cast("string"))
    turn = F.pmod(i, F.lit(4))
    own = headers(("ETag", tag), ("Last-Modified", date), ("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), ("Date", F.concat(F.lit("t"), (3 * i).cast("string"))))
    again = headers(("etag", F.when(turn == 0, F.concat(F.lit("W/"), tag)).when(turn == 3, F.lit('"other"'))), ("last-modified", F.when(turn <= 1, date)), ("content-length", F.lit("0")), ("date", F.concat(F.lit("t"), (3 * i + 7 + turn).cast("string"))), ("cache-control", F.when(turn == 1, F.lit("max-age=60"))))
    first = F.struct((2 * i).alias("record_id"), (3 * i).alias("at"), F.when(F.pmod(i, F.lit(11)) == 0, 404).otherwise(200).alias("status"), digest.alias("digest"), own.alias("headers"))
    second = F.struct((2 * i + 1).alias("record_id"), (3 * i + 7 + turn).alias("at"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"), again.alias("headers"))
    return pages.select("url", F.inline(F.array(first, second)))


def op2(pages: DataFrame) -> DataFrame:
    """What each capture of the crawl log over all pages stands for; headers as sorted lines."""
    out = resolve(pages_as_captures(pages.select("page_id", "url", "html")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return out.withColumn("headers", lines)


OP2_SQL = r"""
WITH p AS (
  SELECT page_id AS i, md5(coalesce(html, '')) AS dg, ((page_id % 4) + 4) % 4 AS turn, url, strlen(coalesce(html, '')) AS size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^[^@]*@', ''), '^www\d*\.', ''), ':(?:80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid|sid)(?:=|$)'))) AS q FROM p
), k AS (
  SELECT *, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical,
    '"' || substr(dg, 1, 16) || '"' AS tag, 'day ' || (i % 1000) AS day FROM u
), c AS (
  SELECT 2 * i AS record_id, canonical, 3 * i AS "at", CASE WHEN ((i % 11) + 11) % 11 = 0 THEN 404 ELSE 200 END AS status, dg, tag, day, size, NULL AS cc, 't' || (3 * i) AS dt FROM k
  UNION ALL
  SELECT 2 * i + 1, canonical, 3 * i + 7 + turn, 304, NULL, CASE turn WHEN 0 THEN tag WHEN 3 THEN '"other"' END, CASE WHEN turn <= 1 THEN day END, 0,
    CASE WHEN turn = 1 THEN 'max-age=60' END, 't' || (3 * i + 7 + turn) FROM k
), b AS (
  SELECT c.*, f.record_id AS bid, f.dg AS bdg, f.tag AS btag, f.day AS bday, f.size AS bsize,
    row_number() OVER (PARTITION BY c.record_id ORDER BY f."at" DESC, f.record_id DESC) AS nth
  FROM c LEFT JOIN (SELECT * FROM c WHERE status = 200) f ON f.canonical = c.canonical AND f."at" < c."at"
), o AS (
  SELECT *, CASE WHEN status = 200 THEN 'full' WHEN status <> 304 THEN 'other' WHEN bid IS NULL THEN 'orphan' WHEN tag IS NULL AND day IS NULL THEN 'unverified'
    WHEN CASE WHEN tag IS NOT NULL THEN tag = btag ELSE day = bday END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM b WHERE nth = 1
)
SELECT record_id, canonical, "at", outcome,
  CASE WHEN outcome = 'full' THEN record_id WHEN outcome IN ('resolved', 'unverified') THEN bid END AS base_id,
  CASE WHEN outcome = 'full' THEN dg WHEN outcome IN ('resolved', 'unverified') THEN bdg END AS body_digest,
  CASE WHEN status <> 304 THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || dt || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: ' || day
    WHEN outcome IN ('resolved', 'unverified') THEN coalesce('cache-control: ' || cc || chr(10), '') || 'content-length: ' || bsize || chr(10) || 'content-type: text/html' || chr(10)
      || 'date: ' || dt || chr(10) || 'etag: ' || coalesce(CASE WHEN record_id % 8 = 1 THEN 'W/' END, '') || coalesce(tag, btag) || chr(10) || 'last-modified: ' || coalesce(day, bday)
    ELSE coalesce('cache-control: ' || cc || chr(10), '') || 'content-length: 0' || chr(10) || 'date: ' || dt
      || coalesce(chr(10) || 'etag: ' || CASE WHEN record_id % 8 = 1 THEN 'W/' ELSE '' END || tag, '') || coalesce(chr(10) || 'last-modified: ' || day, '') END AS headers
FROM o
"""
