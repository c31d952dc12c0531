"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most two bits differ in
at most one bit of some segment, so they share either a whole segment or, when each segment differs in one bit, the
first segment with one position blanked out. Every fingerprint is indexed under its whole segments and under the 32
one-wildcard variants of the first; an equality join meets those that share a key and the full distance is verified.

Each key also carries a piece of the other segment that has to agree (one third of it where up to two bits may
differ there, one half where exactly one may), so a segment that very many texts share does not become one bucket.

Texts of a wanted Jaccard similarity are found by :func:`representatives`: the classes of this method are compared
first, then bands of MinHashes, for pairs of that similarity whose fingerprints are further apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint, components, drop, hot_lookup, small_batches, unused

#: Shingles whose bits are held at once.
CHUNK = 1 << 15
#: MinHash bands of a text, numbered from 1 on, and minima in each. Band 0 is the class of its SimHash. Texts of similarity s share no band with probability
#: (1 - s ** ROWS) ** BANDS: 2e-4 at 0.8, 7e-6 at 0.85.
BANDS, ROWS = 16, 4
#: Bands used in the rounds in which a band's texts meet only one of them, before the rest meet each other: the SimHash
#: classes by themselves, then with bands of MinHashes.
LEADING = (1, 4, 1 + BANDS)
#: Shingles of a text that may be broadcast with 500 like it.
WIDE = 20_000
FACTORS = np.random.default_rng(0).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: Marks keys of whole segments: above the 54 bits of the keys of one-wildcard variants.
WHOLE = 1 << 10


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The hashes of all shingles of a text; null and wordless texts have none, short ones a single one."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], seed) for s, e in spans), dtype="<u8", count=len(parts) - width + 1)


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """The SimHash of one whole text, as a signed 64-bit number; null and wordless texts give 0."""
    return folded(shingles(text, words, seed))


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        block = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, words: int, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs plus its SimHash column ``out`` (long) over shingles of ``words`` words."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, simhash(F.col(text_col)))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(fps: DataFrame) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints in ``fp`` that differ in one or two bits; a pair may repeat."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    parts = fps.select("fp", high.alias("s0"), low.alias("s1"))

    def bits(c: str, at: int, n: int) -> Column:
        return F.shiftrightunsigned(F.col(c), at).bitwiseAND(F.lit((1 << n) - 1))

    def packed(*fields: tuple[Column, int]) -> Column:
        key = F.lit(0).cast("long")
        for value, width in fields:
            key = F.shiftleft(key, width).bitwiseOR(value.cast("long"))
        return key

    whole = [
        packed((F.lit(WHOLE + seg), 11), (F.col(f"s{seg}"), 32), (F.lit(j), 2), (bits(f"s{1 - seg}", at, n), 11))
        for seg in (0, 1)
        for j, (at, n) in enumerate(((0, 11), (11, 11), (22, 10)))
    ]

    def blanked(value: int) -> Column:
        """Keys of the first segment with one position blanked out, for the positions that hold value."""
        has = lambda i: F.expr(f"(shiftrightunsigned(s0, {i}) & 1) = {value}")
        keys = [
            F.when(
                has(i),
                packed((F.lit(i), 5), (F.col("s0").bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))), 32), (F.lit(half), 1), (bits("s1", 16 * half, 16), 16)),
            )
            for i in range(32)
            for half in (0, 1)
        ]
        return F.array_compact(F.array(*keys))

    left = parts.select(F.col("fp").alias("a"), F.explode(F.concat(F.array(*whole), blanked(0))).alias("key"))
    right = parts.select(F.col("fp").alias("b"), F.explode(F.concat(F.array(*whole), blanked(1))).alias("key"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    blank = F.col("key") < (WHOLE << 45)  # one side holds the zeros and the other the ones; whole keys meet both ways
    return left.join(right.hint("merge"), "key").filter((apart <= 2) & (blank | (F.col("a") < F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``fp`` (long) and ``component_id``.

    Documents whose fingerprints differ in at most two bits are linked; component_id is the smallest id reachable.
    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Repeated rows each keep their
    row; a null id never is a component's id unless all its ids are null. Other columns are not read.
    """
    return classes(checkpoint(with_fingerprint(docs.select(F.col(id_col), F.col(text_col)), words, text_col).select(id_col, "fp")), id_col)


def classes(prints: DataFrame, id_col: str) -> DataFrame:
    """prints (``id_col``, ``fp``; read more than once) plus ``component_id``; see :func:`near_duplicates`."""
    distinct = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("_n")))
    found = components(links(distinct.select("fp")))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = roots.filter("root <> fp").groupBy("root").agg(F.min("least").alias("low"))
    size = roots.filter("root <> fp").groupBy("root").agg(F.count("*").alias("_m"))
    dims = checkpoint(
        roots.filter("root = fp").join(lowest, "root", "left").join(size, "root", "left")
        .select("root", F.least("least", "low").alias("component_id"), (1 + F.coalesce("_m", F.lit(0))).alias("_m"))
    )
    named = checkpoint(hot_lookup(roots.select("fp", "root", "_n"), dims, "root", "_m", distinct.count()).select("fp", "component_id", "_n"))
    return hot_lookup(prints, named, "fp", "_n", prints.count())


def op10(docs: DataFrame) -> DataFrame:
    """Fingerprints of three-word shingles and the components they form."""
    return near_duplicates(docs, 3).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash from a hash (the finaliser of splitmix64)."""
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each MinHash band of the shingle hashes."""
    hashes = hashes if len(hashes) else np.zeros(1, dtype=np.uint64)
    least = np.array([(hashes * f).min() for f in FACTORS]).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        keys = mixed(keys ^ least[:, j], 0)
    return keys.view(np.int64)


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``least`` or more. sets: node, hashes."""
    pairs = checkpoint(pairs.select("a", "b").distinct())
    times = pairs.groupBy("b").agg(F.count("*").alias("_n"))
    dims = checkpoint(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")).join(times, "b"))
    met = hot_lookup(pairs, dims, "b", "_n", pairs.count(), F.size("hb") <= WIDE)
    met = met.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    lengths = F.least(F.size("ha"), F.size("hb")) >= least * F.greatest(F.size("ha"), F.size("hb")) - 1e-9
    both = F.size(F.array_intersect("ha", "hb"))
    out = checkpoint(met.filter(lengths & (both * (1 + least) >= least * (F.size("ha") + F.size("hb")) - 1e-9)).select("a", "b"))
    drop(pairs, dims)
    return out


def prefixes(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rarest shingles of every text of ``open_`` (node, root): shingle, node, n (shingles of the text) and place.

    Shingles are ordered from the rarest on, and sets of a Jaccard similarity of ``least`` or more share one of their
    first n - ceil(least n) + 1. Shingles of one text only are counted but left out. So what very many texts share, a
    passage or a template, is in no prefix, and a text of many shingles of its own has none.
    """
    held = open_.select("node").distinct().join(sets, "node")
    each = checkpoint(held.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("shingle")))
    times = checkpoint(each.groupBy("shingle").agg(F.count("*").alias("times")).withColumn("t", F.col("times")))
    met = hot_lookup(each, times, "shingle", "times", each.count())
    place = F.row_number().over(Window.partitionBy("node").orderBy("t", "shingle"))
    reach = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    out = checkpoint(met.withColumn("place", place).filter((F.col("place") <= reach) & (F.col("t") > 1)).drop("t"))
    drop(each, times)
    return out


def prefix_pairs(first: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of different roots that share a shingle of ``first`` (see :func:`prefixes`, with root): every
    pair whose sets have a Jaccard similarity of ``least`` or more, and few others. At the first shingle that a pair
    shares, what is left of either must be enough for the overlap that the similarity asks for."""
    side = lambda k: first.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "place")])
    overlap = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    enough = overlap * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    close = (F.col("root_a") != F.col("root_b")) & smaller & (F.col("n_a") >= least * F.col("n_b") - 1e-9)
    return side("a").join(side("b"), "shingle").filter(close & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def band_links(bands: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts of similarity ``least`` or more that share a band. bands: band, key, node.

    Band 0 holds the SimHash classes. In each of the LEADING rounds a band's texts are compared with one of them, another one each round, unless they
    are connected by then. Among the texts of the bands that hold several components still, those pairs are compared
    that :func:`prefix_pairs` leaves, first of one text for each shingle and component, then of all that are not
    connected by then. So any two texts of that similarity that share a band are linked or connected.
    """
    def rest(root: DataFrame | None, used: int) -> DataFrame:
        """Rows of the first ``used`` bands of each text that hold several components, with the component."""
        some = bands.filter(F.col("band") < used)
        if root is None:
            return some.withColumn("root", F.col("node"))
        named = checkpoint(some.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
        several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("_n"))
        several = checkpoint(several.filter("low <> high").select("key", "_n", F.lit(True).alias("open")))
        out = checkpoint(hot_lookup(named, several, "key", "_n", named.count()).filter("open").drop("open"))
        drop(named, several)
        return out

    found, root = None, None
    for nth, used in enumerate(LEADING):
        open_ = rest(root, used)
        lead = checkpoint(open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(nth)).alias("h"), "node", "root")).alias("lead"), F.count("*").alias("_n")))
        met = hot_lookup(open_, lead, "key", "_n", open_.count()).filter("root <> lead.root")
        good = alike(met.select(F.col("node").alias("a"), F.col("lead.node").alias("b")), sets, least)
        found = good if found is None else found.unionByName(good)
        root = components(found)
        drop(lead)
    first = prefixes(rest(root, LEADING[-1]), sets, least)
    for one in (True, False):
        rows = checkpoint(first.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
        if one:
            head = F.min(F.struct(F.xxhash64("node", "shingle").alias("h"), "node", "n", "place")).alias("x")
            rows = checkpoint(rows.groupBy("shingle", "root").agg(head).select("shingle", "root", "x.node", "x.n", "x.place"))
        found = found.unionByName(alike(prefix_pairs(rows, least), sets, least))
        root = components(found) if one else root
    return found


def representatives(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each near-duplicate group.

    Candidates are texts of one SimHash class over their ``words``-word shingles (fingerprints linked at two bits, see
    :func:`classes`) and, for pairs whose fingerprints are further apart, texts that share a band of MinHashes over
    the same shingles. They are linked if the Jaccard similarity of the shingle sets is ``least`` or more (see
    :func:`band_links`). Groups are connected components. The document of the smallest id stays, and of several rows of that id the one of the smallest text hash;
    identical rows become one. Rows with a null id stay only if their group has no other. Null, empty and wordless texts
    are copies of each other. Texts count as equal if their MD5 is. Other columns pass through.
    """
    small_batches(docs.sparkSession)
    md5, nth = unused(docs, "_text"), unused(docs, "_nth")

    @F.pandas_udf("fp long, bands array<long>")
    def printed(texts: pd.Series) -> pd.DataFrame:
        hashes = [shingles(t, words) for t in texts]
        return pd.DataFrame({"fp": pd.Series([folded(h) for h in hashes], dtype="int64"), "bands": pd.Series([band_keys(h) for h in hashes], dtype=object)})

    @F.pandas_udf("array<long>")
    def distinct_shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(h).view(np.int64) if len(h) else np.zeros(1, dtype=np.int64) for h in (shingles(t, words) for t in texts)])

    own = docs.withColumn(md5, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    made = checkpoint(own.select(F.col(id_col).alias("id"), F.col(md5).alias("md5"), printed(F.col(text_col)).alias("made")))
    texts = made.groupBy("md5").agg(F.min("id").alias("id"), F.first("made.fp").alias("fp"), F.first("made.bands").alias("bands"))
    texts = checkpoint(texts.withColumn("node", F.monotonically_increasing_id()))
    drop(made)

    def rows_of(keys: DataFrame) -> DataFrame:
        """The rows of docs that have the ids and texts of keys (_id, _md5, ...), with the other columns of keys."""
        met = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(md5) == F.col("_md5"))
        return own.join(keys, met, "left_semi" if len(keys.columns) == 2 else "inner")

    near = checkpoint(classes(texts.select("node", "fp"), "node"))
    each = texts.select("node", F.posexplode("bands").alias("at", "key")).select("node", (F.col("at") + 1).alias("band"), "key")
    each = each.unionByName(near.select("node", F.lit(0).alias("band"), F.col("component_id").alias("key")))
    shared = checkpoint(each.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("shared", F.lit(True)))
    bands = checkpoint(hot_lookup(each, shared, "key", "_n", texts.count() * (1 + BANDS)).filter("shared").drop("shared"))
    needed = texts.join(bands.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("_id"), F.col("md5").alias("_md5"), F.col("node").alias("_node"))
    sets = rows_of(needed).select("_node", F.col(text_col).alias("text")).dropDuplicates(["_node"])
    sets = checkpoint(sets.select(F.col("_node").alias("node"), distinct_shingles("text").alias("hashes")))
    found = components(band_links(bands, sets, least))
    rooted = texts.select("node", F.struct(F.col("id").isNull().alias("none"), "id", "md5").alias("k")).join(found, "node", "left")
    best = rooted.filter("root is not null").groupBy("root").agg(F.min("k").alias("k")).select("k")
    keep = checkpoint(rooted.filter("root is null").select("k").unionByName(best).select(F.col("k.id").alias("_id"), F.col("k.md5").alias("_md5")))
    drop(near, shared, bands, sets)
    first = F.row_number().over(Window.partitionBy(id_col, md5).orderBy(F.lit(1)))
    return rows_of(keep).withColumn(nth, first).filter(F.col(nth) == 1).select(*docs.columns)
