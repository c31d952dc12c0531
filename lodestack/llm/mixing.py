"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. With r = target / words of the source, each of its documents is taken
floor(r) times for certain. What is missing is a sample without replacement with unequal inclusion probabilities: p is
proportional to a document's words, so that the expected words of the sample are those missing. Documents for which
that would be 1 or more are taken once more for certain, and the others' p is made anew from what is then missing.
Documents are ranked by the odds of a random number over the odds of p (Rosen's Pareto sampling) and the sample is the
prefix of that order whose words come nearest to what is missing, so its size in words is fixed. Runs repeat exactly:
the random number is a hash of the document's id and text and a seed.

No source is sorted in one place. The certain documents follow from the counts of each size; the prefix is found over
4096 bins of the rank, the bin that the target falls into is cut into 4096 again, and only what is left in that one
fine bin is ordered, equal rows as one. If only some of several equal rows fit, they are numbered within the parts of
a table that holds no other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint, sized_lookup

# White space separates words; sources weigh 3, 1, 2 in code point order, repeating.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BINS = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def digest(id_col: Column, text_col: Column, seed: str) -> Column:
    """MD5 of a row's id and text: the same for equal rows, different for any others."""
    named = F.coalesce(F.concat(F.lit("s"), id_col.cast("string")), F.lit("n"))
    return F.md5(F.concat(F.lit(seed), named, F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).cast("binary"))


def uniform(digest: Column) -> Column:
    """A number strictly between 0 and 1: 52 bits of the digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (key, source, source_size, ...) plus target: share of all words dealt out by weight, each source at most
    ``most`` times its own words, what is above going to the others by weight until none is above."""
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    out = out.withColumn("_all", F.lit(share) * F.sum("source_size").over(every)).withColumn("_sum_w", F.sum("_w").over(every))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    out = out.withColumn("_c", F.coalesce(F.sum("_cap").over(filling), none)).withColumn("_v", F.coalesce(F.sum("_w").over(filling), none))
    full = F.col("_cap") * (F.col("_sum_w") - F.col("_v")) <= F.col("_w") * (F.col("_all") - F.col("_c"))
    out = out.withColumn("_full", full)
    taken = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(every), none)
    out = out.withColumn("_fc", taken("_cap")).withColumn("_fw", taken("_w"))
    level = F.col("_w") * (F.col("_all") - F.col("_fc")) / F.nullif(F.col("_sum_w") - F.col("_fw"), none)
    return out.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(level)).select(*sources.columns, "target")


def with_odds(plan: DataFrame, ranked: DataFrame) -> DataFrame:
    """plan (key, missing, ...) plus certain (documents of so many words or more are taken once more for certain; null:
    none), share (p of a document is its words times this) and left (words missing besides those certain)."""
    falling = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.filter("size > 0").groupBy("key", "size").agg(F.count("*").cast("decimal(19,0)").alias("_m"))
    sizes = sizes.withColumn("_w", (F.col("_m") * F.col("size")).cast("decimal(38,0)")).withColumn("_q", (F.col("_w") * F.col("size")).cast("decimal(38,0)"))
    above = lambda c: F.coalesce(F.sum(c).over(falling), F.lit(0)).cast("decimal(38,0)").cast("double")
    total = F.sum("_q").over(Window.partitionBy("key")).cast("decimal(38,0)").cast("double")
    sizes = sizes.withColumn("_larger", above("_w")).withColumn("_rest", total - above("_q"))
    met = sizes.join(plan.select("key", "missing"), "key")
    goes = F.col("size") * (F.col("missing") - F.col("_larger")) >= F.col("_rest")
    first = met.filter(~goes).groupBy("key").agg(F.max_by(F.struct("_larger", "_rest"), "size").alias("f"), F.max("size").alias("_largest"))
    least = met.filter(goes).groupBy("key").agg(F.min("size").alias("certain"))
    out = plan.join(first, "key", "left").join(least, "key", "left")
    left = F.greatest(F.col("missing") - F.coalesce("f._larger", F.lit(0.0)), F.lit(0.0))
    return out.withColumn("left", left).withColumn("share", F.coalesce(F.col("left") / F.nullif(F.col("f._rest"), F.lit(0.0)), F.lit(0.0))).drop("f", "_largest")


def crossing(rows: DataFrame, bin_col: str, missing: str) -> DataFrame:
    """For each key the first bin that does not fit whole into the missing words, and the words before it."""
    order = Window.partitionBy("key").orderBy(bin_col)
    bins = rows.groupBy("key", bin_col, missing).agg(F.sum("size").alias("_s")).withColumn("_end", F.sum("_s").over(order))
    first = bins.filter(F.col("_end") > F.col(missing)).groupBy("key").agg(F.min(F.struct(bin_col, (F.col("_end") - F.col("_s")).alias("before"))).alias("x"))
    return first.select("key", F.col(f"x.{bin_col}").alias(f"_{bin_col}"), "x.before")


def with_rank(rows: DataFrame) -> DataFrame:
    """rows (digest, size, certain, share) plus sure, and for the others the rank t in [0, 1) and its bin and fine bin;
    documents without words, and all where nothing is left to sample, have no rank."""
    u, p = uniform(F.col("digest")), F.col("size") * F.col("share")
    sure = F.coalesce(F.col("size") >= F.col("certain"), F.lit(False))
    q = F.when(~sure & (p > 0), (u / (1 - u)) * ((1 - p) / p))
    out = rows.withColumn("sure", sure).withColumn("t", q / (1 + q)).withColumn("bin", F.floor(F.col("t") * BINS))
    return out.withColumn("fine", F.floor(F.col("t") * BINS * BINS) - F.col("bin") * BINS)


def numbered(ties: DataFrame) -> DataFrame:
    """ties (key, ...) plus nth, from 1 within each key, in any order. They are written first, so that the numbers stay.
    Rows are counted by part of the table and numbered within it."""
    held = checkpoint(ties.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = held.groupBy("key", "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("key", "_part").orderBy("_at"))
    return held.withColumn("nth", within).join(parts, ["key", "_part"]).withColumn("nth", F.col("nth") + F.col("_before")).drop("_at", "_part", "_before")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: str = "pareto:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs plus size, source_size (long), target (double), copies and taken (long: words the mix takes).

    A null text has no words; documents without words are never sampled. A null source is a source of its own, the
    last. The taken words of a source miss its target by half of one document at most. Of rows of equal id, text and
    source as many are taken as fit, whichever they are. Ids may be of any type that casts to a string, null included.
    An empty table gives no rows. Existing columns of the new names are replaced.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    made = ("size", "source_size", "target", "copies", "taken", "key", "digest")
    sized = docs.drop(*[c for c in made if c not in (id_col, text_col, source_col)])
    sized = sized.withColumn("size", n_words(F.col(text_col))).withColumn("key", key).withColumn("digest", digest(F.col(id_col), F.col(text_col), seed))
    ranked = checkpoint(sized.select("key", F.col(source_col).alias("source"), "size", "digest"))
    sums = ranked.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    plan = targets(sums, share, most)
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio))
    plan = checkpoint(plan.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")))
    plan = checkpoint(with_odds(plan, ranked))

    at = sized_lookup(ranked, plan.select("key", "_n", "certain", "share", "left"), "key", "_n")
    at = with_rank(at).filter("t is not null")
    coarse = checkpoint(crossing(at, "bin", "left"))
    inner = at.join(coarse, (at["key"] == coarse["key"]) & (at["bin"] == coarse["_bin"])).drop(coarse["key"])
    inner = checkpoint(inner.withColumn("left", F.col("left") - F.col("before")).groupBy("key", "fine", "t", "digest", F.col("size").alias("each"), "left").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    second = checkpoint(crossing(inner, "fine", "left"))
    last = inner.join(second, (inner["key"] == second["key"]) & (inner["fine"] == second["_fine"])).drop(second["key"])
    order = Window.partitionBy("key").orderBy("t", "digest").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("left", F.col("left") - F.col("before")).withColumn("_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    near = F.floor((F.col("left") - F.col("_start")) / F.col("each") + 0.5).cast("long")
    fits = lambda n: (2 * (F.col("_start") + n * F.col("each")) - F.col("each")).cast("double") < 2 * F.col("left")
    fit = F.array_max(F.filter(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.least(F.greatest(near + k, F.lit(0)), F.col("rows"))), lambda n: (n == 0) | fits(n)))
    cut = last.withColumn("fit", F.coalesce(fit, F.lit(0))).filter("fit > 0").groupBy("key").agg(F.max(F.struct("t", "digest", "fit", "rows")).alias("cut"))
    dims = plan.join(coarse.drop("before"), "key", "left").join(second.drop("before"), "key", "left").join(cut, "key", "left")
    dims = checkpoint(dims.drop("source"))

    out = with_rank(sized_lookup(sized, dims, "key", "_n"))
    place, end = F.struct("t", "digest"), F.struct("cut.t", "cut.digest")
    within = (F.col("fine") < F.coalesce("_fine", F.lit(BINS))) | ((F.col("fine") == F.col("_fine")) & F.coalesce(place <= end, F.lit(False)))
    picked = F.coalesce((F.col("bin") < F.coalesce("_bin", F.lit(BINS))) | ((F.col("bin") == F.col("_bin")) & within), F.lit(False))
    out = out.withColumn("_more", (F.col("sure") & (F.col("missing") > 0)) | picked)
    if dims.filter("cut.fit < cut.rows").limit(1).count():
        tied = F.coalesce((F.col("cut.fit") < F.col("cut.rows")) & (place == end), F.lit(False))
        some = numbered(out.filter(tied)).withColumn("_more", F.col("nth") <= F.col("cut.fit")).drop("nth")
        out = out.filter(~tied).unionByName(some)
    out = out.withColumn("copies", (F.col("whole") + F.col("_more").cast("int")).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*[c for c in docs.columns if c in (id_col, text_col, source_col) or c not in made], "size", "source_size", "target", "copies", "taken")


def op8(docs: DataFrame) -> DataFrame:
    """Mix all documents to 150 % of their words; every row, with what the mix takes of it."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS sw FROM s
), g AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS c, coalesce(sum(w) OVER o, 0) AS v FROM f
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, cap * (sw - v) <= w * (total - c) AS filled FROM g
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN cap ELSE w * (total - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0))
    / nullif(sw - coalesce(sum(CASE WHEN filled THEN w END) OVER (), 0), 0) END AS target FROM h
), p AS (
  SELECT *, floor(coalesce(target / nullif(source_size, 0), 0)) AS whole FROM t
), m AS (
  SELECT *, target - whole * source_size AS missing FROM p
), hist AS (
  SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size
), tail AS (
  SELECT h.*, m.missing, coalesce(sum(n * h.size) OVER o, 0)::DOUBLE AS larger,
    sum(n * h.size * h.size) OVER (PARTITION BY h.source)::DOUBLE - coalesce(sum(n * h.size * h.size) OVER o, 0)::DOUBLE AS rest
  FROM hist h JOIN m ON h.source IS NOT DISTINCT FROM m.source
  WINDOW o AS (PARTITION BY h.source ORDER BY h.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), side AS (
  SELECT source, min(CASE WHEN size * (missing - larger) >= rest THEN size END) AS certain,
    max_by(larger, CASE WHEN size * (missing - larger) < rest THEN size END) AS larger,
    max_by(rest, CASE WHEN size * (missing - larger) < rest THEN size END) AS rest FROM tail GROUP BY source
), o AS (
  SELECT m.*, certain, greatest(missing - coalesce(larger, 0.0::DOUBLE), 0.0::DOUBLE) AS remaining,
    coalesce(greatest(missing - coalesce(larger, 0.0::DOUBLE), 0.0::DOUBLE) / nullif(rest, 0), 0) AS odds
  FROM m LEFT JOIN side ON m.source IS NOT DISTINCT FROM side.source
), u AS (
  SELECT d.doc_id, d.size, o.*, d.size * o.odds AS p, coalesce(d.size >= o.certain, false) AS sure, d.digest,
    (CAST(('0x' || substr(d.digest, 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, md5('pareto:' || coalesce('s' || CAST(doc_id AS VARCHAR), 'n') || ':' || md5(coalesce(text, ''))) AS digest FROM d) d
  JOIN o ON d.source IS NOT DISTINCT FROM o.source
), q AS (
  SELECT *, CASE WHEN NOT sure AND p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM u
), z AS (
  SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, digest ROWS UNBOUNDED PRECEDING) AS cum FROM q
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN (sure AND missing > 0) OR (q IS NOT NULL AND 2 * cum - size < 2 * remaining) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM z
"""
