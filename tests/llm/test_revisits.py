import random

from lodestack.llm import revisits

SCHEMA = "record_id long, url string, at long, status int, digest string, headers array<struct<name:string,value:string>>"


def test_whole_table(spark, sf_dir, oracle, same_rows):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = [r.asDict() for r in revisits.op2(pages).collect()]
    same_rows(got, oracle(revisits.OP2_SQL))
    assert {r["outcome"] for r in got} >= {"full", "other", "resolved", "unverified", "mismatch", "orphan"}


def test_hot_url_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        url = "http://www.Hot.example/a/?utm_source=x#f" if rng.random() < 0.6 else f"https://h{i % 400}.example/p?b=2&a={i % 3}"
        status = rng.choice([200, 304, 304, 500])
        tag = rng.choice([None, '"a"', '"b"'])
        rows.append((i, rng.choice([url, url, url, None]), rng.choice([None, *range(900)] + [5] * 99), status, f"d{i}" if status == 200 else None, rng.choice([None, [("ETag", tag)] if tag else []])))
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 3000
    canon = {i: r.canonical for i, r in got.items()}
    for i, url, at, status, digest, heads in rows:
        if status != 304:
            assert got[i].outcome == ("full" if status == 200 else "other")
            continue
        earlier = [r for r in rows if r[3] == 200 and url and at is not None and r[2] is not None and canon[r[0]] == canon[i] and r[2] < at]
        if not earlier:
            assert (got[i].outcome, got[i].base_id) == ("orphan", None)
            continue
        b = max(earlier, key=lambda r: (r[2], r[0]))
        own, held = dict(heads or []).get("ETag"), dict(b[5] or []).get("ETag")
        want = "unverified" if own is None else "resolved" if own == held else "mismatch"
        assert got[i].outcome == want and got[i].base_id == (None if want == "mismatch" else b[0]), i


def test_urls_and_empty_table(spark):
    urls = ["HTTP://user@WWW2.A.com:80/x/y/?b=1&utm_source=q&a=2&ref=#z", "a.com/x/y?a=2&b=1", "https://a.com", "a.com/", None]
    got = [r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select(revisits.canonical_url(revisits.F.col("u")).alias("c")).collect()]
    assert got == ["a.com/x/y?a=2&b=1", "a.com/x/y?a=2&b=1", "a.com", "a.com", None]
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_long_values_and_further_columns(spark):
    url = "http://a.com/" + "x" * 50_000
    rows = [(1, url, 1, 200, "d", [("ETag", "t" * 100_000)])] * 3 + [(2, url, 5, 304, None, [("etag", "t" * 100_000), ("Date", "now")])] * 2 + [(3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"canonical": revisits.F.lit("x"), "base_id": revisits.F.lit(9), "run": revisits.F.lit("y"), "full": revisits.F.lit(0)})
    got = sorted((r.record_id, r.outcome, r.base_id, r.body_digest, len(r.headers)) for r in revisits.resolve(df).collect())
    assert got == [(1, "full", 1, "d", 1)] * 3 + [(2, "resolved", 1, "d", 2)] * 2 + [(3, "other", None, None, 0)]


def test_carried_rows_that_are_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, "http://hot.com/", i, 200 if i % 7 == 0 else 304, f"d{i}", [("ETag", "a")]) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, revisits.resolve(df).collect()))
    monkeypatch.setattr(revisits, "FEW", 0)
    assert sorted(map(str, revisits.resolve(df).collect())) == whole
