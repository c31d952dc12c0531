import pyarrow as pa
import pytest

from lodestack.llm import mixing


def test_whole_table(spark, sf_dir, oracle, same_rows):
    got = [r.asDict() for r in mixing.op8(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()]
    same_rows(got, oracle(mixing.OP8_SQL))


def test_targets_are_met_and_runs_agree(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 50 = 1 then null else concat('s', id % 7) end as source", "repeat('w ', cast(id % 40 as int)) as text", "1 as target", "'x' as key")
    rows = mixing.mix(df).collect()
    assert len(rows) == 6000
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source, r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - k[2]) <= 20 for k, t in by.items()), by.keys()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_inclusion_follows_size(spark):
    """Within a source, documents of more words are taken more often, in proportion until it is certain."""
    df = spark.range(20000).selectExpr("id as doc_id", "case when id < 10000 then 'a' else 'b' end as source", "repeat('w ', cast(case when id % 10 = 9 then 200 else id % 10 + 1 end as int)) as text")
    rows = [r for r in mixing.mix(df, share=0.5).collect() if r.source == "b"]
    share = {n: sum(r.taken > 0 for r in rows if r.size == n) / sum(r.size == n for r in rows) for n in {r.size for r in rows}}
    p = {n: n * share[9] / 9 for n in range(1, 10)}
    assert share[200] == pytest.approx(1) or share[200] > 10 * share[9]
    assert all(abs(share[n] - p[n]) < 0.05 for n in range(1, 10))
    assert share[1] < share[5] < share[9]


def test_equal_rows_are_told_apart(spark, oracle, same_rows):
    """Of equal rows as many are taken as fit, with one id and with none, and alike in SQL."""
    for doc_id in (7, None):
        rows = [(doc_id, "a b c d e", "hot")] * 100 + [(1000 + i, "x " * 20, "z") for i in range(25)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = [r.asDict() for r in mixing.op8(df.repartition(5)).collect()]
        hot = [r for r in got if r["doc_id"] == doc_id]
        assert abs(sum(r["taken"] for r in hot) - hot[0]["target"]) <= 2.5 and 0 < hot[0]["target"]
        table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
        same_rows(got, oracle(mixing.OP8_SQL, documents=table))


def test_ids_of_any_type_and_shared_ids(spark, oracle, same_rows):
    df = spark.createDataFrame([(f"u{i}", "w " * (i % 9), "ab"[i % 2]) for i in range(300)], "doc_id string, text string, source string")
    assert mixing.mix(df).count() == 300
    rows = [(i % 3, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(900)]
    shared = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    same_rows([r.asDict() for r in mixing.op8(shared).collect()], oracle(mixing.OP8_SQL, documents=table))


def test_odd_rows(spark, oracle, same_rows):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "x", "b"), (4, "é y z " * 50, "c"), (5, "q\x0bq\x1cq", ""), (6, "long " * 60_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("digest", mixing.F.lit(1)).withColumn("copies", mixing.F.lit("x"))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    same_rows([r.asDict() for r in mixing.op8(df).collect()], oracle(mixing.OP8_SQL, documents=table))
    assert mixing.op8(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.op8(df.filter("doc_id < 3")).collect())


def test_sources_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(900).selectExpr("id as doc_id", "concat('s', case when id < 400 then 0 else id % 90 end) as source", "'a b c' as text")
    whole = sorted(map(str, mixing.op8(df).collect()))
    look = mixing.sized_lookup
    monkeypatch.setattr(mixing, "sized_lookup", lambda *a: look(*a, most_rows=3))
    assert sorted(map(str, mixing.op8(df).collect())) == whole
