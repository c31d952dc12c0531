import random
from collections import defaultdict

import xxhash

from lodestack.llm import common, simhash


def brute_print(text, words=3):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [p for p in parts.split(" ") if p]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    for t in [None, "", " \n", "One", "one TWO", "a b c", "a b c a b c a b c", "É e x É y z \x0b q", "x " * 70000]:
        got = simhash.fingerprint(t, 3) & (2**64 - 1)
        assert got == (brute_print(t) if not t or len(t) < 1000 else simhash.fingerprint("x x x", 3) & (2**64 - 1))


def test_fingerprint_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h == simhash.fingerprint("A b  c", 3)


def test_links_find_every_close_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {0, 1, 3, 2**63, 2**63 + 1}
    for b in base:
        fps |= {b, b ^ 1 << rng.randrange(64), b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), b ^ 7, b ^ (5 << 30), b ^ (1 << 40 | 1 << 3)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4999), (7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in brute_components({x for e in edges for x in e}, edges).items() if n != 7 or r == 0}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_beyond_one_task(spark, monkeypatch):
    """The same components when links are too many for one task and its memory."""
    monkeypatch.setattr(common, "ONE_TASK", 10)
    monkeypatch.setattr(common, "REMEMBERED", 20)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] * 2
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = brute_components({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fp = {r.doc_id: brute_print(r.text) for r in rows}
    by = defaultdict(list)
    for d, f in fp.items():
        by[f].append(d)
    reps = list(by)
    linked = [(by[a][0], by[b][0]) for i, a in enumerate(reps) for b in reps[:i] if (a ^ b).bit_count() <= 2]
    linked += [(ds[0], d) for ds in by.values() for d in ds]
    want = brute_components(list(fp), linked)
    got = simhash.op10(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in fp.items()}


def test_odd_rows(spark):
    rows = [(5, "", 1), (3, None, 2), (9, " \t", 3), (None, "a b c d", 4), (7, "a b c d", 5), (7, "a b c d", 5), (None, "zz", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(simhash.op10(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint))
    assert [(r.doc_id, r.component_id) for r in got[:5]] == [(3, 3), (5, 3), (7, 7), (7, 7), (9, 3)]
    assert sorted(str(r.component_id) for r in got[5:]) == ["7", "None"]
    assert simhash.op10(df.limit(0)).count() == 0


def test_representatives_of_copies_and_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "ka", "so"]) for _ in range(rng.randrange(2, 6)))
    rows, groups = [], []
    for g in range(25):
        base = [word() for _ in range(300)]
        ids = []
        for k in range(rng.choice([1, 2, 3, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(300)] = word()
            ids.append(1000 - len(rows))
            rows.append((ids[-1], " ".join(own)))
        groups.append(ids)
    rows += [(2000, rows[0][1]), (2000, rows[0][1]), (None, rows[0][1]), (None, "lone words here"), (None, "lone words here"), (3000, None), (3001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", simhash.F.lit("x")).withColumn("node", simhash.F.lit(1))
    got = simhash.representatives(df)
    assert got.columns == ["doc_id", "text", "_text", "node"] and got.filter("_text <> 'x'").count() == 0
    ids = [r.doc_id for r in got.collect()]
    need = [min(g) for g in groups] + [None, 3000]
    assert set(need) <= set(ids) and ids.count(None) == 1 and len(ids) == len(set(ids))
    assert len(ids) - len(need) <= 0.1 * (sum(map(len, groups)) - len(groups))
    assert not {2000, 3001} & set(ids)
    assert simhash.representatives(df.limit(0)).count() == 0


def test_near_copies_under_strangers_are_found(spark):
    """Near copies among many texts over one small vocabulary, whose word prints are alike."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(60)]
    rows, groups = [], []
    for g in range(30):
        base = [rng.choice(pool) for _ in range(600)]
        ids = []
        for k in range(3):
            own = list(base)
            for at in rng.sample(range(600), 5 * k):
                own[at] = rng.choice(pool)
            ids.append(len(rows))
            rows.append((ids[-1], " ".join(own)))
        groups.append(ids)
    grams = [{tuple(w[i : i + 5]) for i in range(596)} for w in (t.split() for _, t in rows)]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    want = brute_components(range(len(rows)), alike)
    assert len(set(want.values())) == 30
    got = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == set(want.values())


def test_texts_under_the_similarity_stay(spark):
    """Each text of a pair of similarity 0.6 to 0.8 is kept, close as the fingerprints may be; one of each pair above goes."""
    rng = random.Random(12)
    rows, want = [], set()
    for g in range(60):
        base = [f"u{rng.randrange(50_000)}" for _ in range(400)]
        own = list(base)
        for at in rng.sample(range(400), rng.choice([4, 12, 14, 16])):
            own[at] = f"v{rng.randrange(50_000)}"
        grams = [{tuple(w[i : i + 5]) for i in range(396)} for w in (base, own)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
        want |= {2 * g} | ({2 * g + 1} if len(grams[0] & grams[1]) < 0.8 * len(grams[0] | grams[1]) else set())
    assert 80 < len(want) < 120
    got = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_pairs_without_a_common_band_are_found_by_their_fingerprints(spark):
    """Texts of similarity 0.8 that share no band of MinHashes, but whose SimHashes differ in two bits."""
    rows = []
    for n, tail in ((22434, 5), (31044, 3)):
        base = [f"w{n}x{i}" for i in range(8)] * 40 + [f"w{n}x{i}" for i in range(tail)]
        rows += [(len(rows) + k, " ".join([*base, last])) for k, last in enumerate(("left", "right"))]
    for (_, a), (_, b) in (rows[:2], rows[2:]):
        one, two = simhash.shingles(a, 5), simhash.shingles(b, 5)
        assert 5 * len(set(one) & set(two)) >= 4 * len(set(one) | set(two))
        assert not (simhash.band_keys(one) == simhash.band_keys(two)).any()
        assert ((simhash.folded(one) ^ simhash.folded(two)) & (2**64 - 1)).bit_count() <= 2
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 2]


def test_one_class_of_unlike_texts(spark):
    """One passage repeated many times gives all texts one SimHash class; only those of similarity 0.8 are one group."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(9)] * 150
    rows = []
    for g in range(20):
        own = [f"o{rng.randrange(50_000)}" for _ in range(60)]
        rows += [(3 * g + k, " ".join(passage + own + [f"last{k}"])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert simhash.near_duplicates(df, 5).select("component_id").distinct().count() == 1
    assert {r.doc_id for r in simhash.representatives(df).collect()} == {3 * g for g in range(20)}
