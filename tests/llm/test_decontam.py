import random

import numpy as np

from lodestack.llm import decontam


def edits_anywhere(item, text):
    """Fewest edits of item against any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(prev[j - 1] + (c != t), prev[j] + 1, row[j - 1] + 1))
    return min(row)


def damaged(rng, text, n):
    for _ in range(n):
        p = rng.randrange(len(text))
        text = rng.choice([text[:p] + text[p + 1 :], text[:p] + "x" + text[p:], text[:p] + "y" + text[p + 1 :]])
    return text


def test_align_matches_plain_table():
    rng = random.Random(2)
    for _ in range(60):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(8, 40)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 30))) + damaged(rng, item, rng.randrange(5)) + "bca"
        got = decontam.align(decontam.codes(item), decontam.codes(text), -len(item), len(text), 99)
        assert got[0] == edits_anywhere(item, text)
        cut = decontam.align(decontam.codes(item), decontam.codes(text[got[1] : got[2]]), -len(item), len(text), 99)
        assert cut[0] == got[0]


def test_search_finds_all_within_the_budget_and_no_more():
    rng = random.Random(4)
    syllables = ["the ", "ing", "on", "er ", "and ", "ha", "re ", "st", "of the "]
    make = lambda n: decontam.normal("".join(rng.choice(syllables) for _ in range(n)))
    items = [make(rng.randrange(15, 60)) for _ in range(8)]
    index = decontam.Index(list(range(8)), items)
    texts, want = [], set()
    for _ in range(40):
        k = rng.randrange(8)
        texts.append(decontam.normal(make(15) + " " + damaged(rng, items[k], rng.choice([0, 1, 3, 6, 9, 14, 20])) + " " + make(15)))
    got = {(i, k): (e, s, t) for i, k, e, s, t in index.search(texts)}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            e = edits_anywhere(item, t)
            assert ((i, k) in got) == (e <= index.budget[k]), (i, k, e)
            if (i, k) in got:
                assert got[i, k][0] == e and edits_anywhere(item, t[got[i, k][1] : got[i, k][2]]) == e


def test_whole_table_holds_every_verbatim_item(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r for r in decontam.op3(docs, bench).collect()}
    texts, items = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    exact = {(d, k) for d, t in texts.items() for k, q in items.items() if decontam.normal(q) and decontam.normal(q) in decontam.normal(t)}
    assert exact and exact == {k for k, r in got.items() if r.n_edits == 0}
    for (d, k), r in got.items():
        assert edits_anywhere(decontam.normal(items[k]), decontam.normal(texts[d][r.start : r.end])) == r.n_edits
    left = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in got}
    small = decontam.contamination(docs, bench, block=500)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(got)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "Hi, there"), (2, None), (3, " .,"), (4, "tiny"), (5, "abcdefgh ijklm nopqr stuvw xyz")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "say HI  THERE now"), (2, "a tiny one"), (2, "a tiny one"), (3, "tinyish"), (4, "The abcdefgh\nijklm-nopqr stuvw xy" + "z" * 3)], "doc_id long, text string")
    got = sorted(map(tuple, decontam.op3(docs, bench).collect()), key=str)
    assert [g[:2] for g in got] == [(2, 4), (2, 4), (4, 5), (None, 1)]
    assert decontam.op3(docs, bench.limit(0)).count() == 0 == decontam.op3(docs.limit(0), bench).count()
    assert decontam.clean(docs, bench).count() == 3


def test_normal_forms():
    assert decontam.normal("A,  b\tİç_9!") == "a b " + decontam.lowered("İ") + "ç 9"
    assert decontam.grams(np.zeros(3, dtype=np.uint8)).size == 0


def test_whole_table_with_edits_against_plain_alignment(spark, sf_dir):
    """Damaged items put into documents of the table: every document against every item by an alignment without filter."""
    rng = random.Random(11)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 1500").collect()}
    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    items = {k: t for k, t in items.items() if len(t) >= decontam.Q}
    for n, d in enumerate(sorted(docs)):
        if n % 2:
            k = rng.choice(sorted(items))
            own, at = damaged(rng, items[k], int(len(items[k]) * rng.choice([0.02, 0.06, 0.09, 0.12, 0.2]))), docs[d].find(" ") + 1
            docs[d] = f"{docs[d][:at]}{own} {docs[d][at:]}"

    def fewest(item, text, most):
        """edits_anywhere in whole rows of numpy, given up above ``most``."""
        t, far = np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), np.arange(len(text) + 1)
        row = np.zeros(len(t) + 1, dtype=np.int64)
        for i, c in enumerate(item, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(c)))
            row = np.minimum.accumulate(np.concatenate(([i], new)) - far) + far
            if row.min() > most:
                return most + 1
        return int(row.min())

    index = decontam.Index(list(items), list(items.values()))
    budget = dict(zip(items, index.budget.tolist(), strict=True))
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").withColumns({"item_id": decontam.F.lit("x"), "n_edits": decontam.F.lit(1)})
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("doc_id", decontam.F.lit(7))
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontam.op3(df, bench).collect()}
    want = {(d, k): e for d, t in docs.items() for k, item in items.items() if (e := fewest(item, decontam.normal(t), budget[k])) <= budget[k]}
    assert {p: e for p, e in got.items() if p[1] in items} == want and sum(e > 0 for e in want.values()) > 10
