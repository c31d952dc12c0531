import random

import pyarrow as pa

from lodestack.llm import winnow


def test_whole_table(spark, sf_dir, oracle, same_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [r.asDict() for r in winnow.op4(docs).collect()]
    same_rows(got, oracle(winnow.OP4_SQL))
    assert sum(r["n_deleted"] for r in got) > 20


def test_odd_rows_against_sql(spark, oracle, same_rows):
    rng = random.Random(1)
    pool = ["one two three four five", "a", "b c", "  a\t", "", " \t", "six seven eight nine ten eleven", "z z z z z", "é ü ñ ö ß"]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, "", *["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(6)]])) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_hash", winnow.F.lit("x")).withColumn("n_lines", winnow.F.lit(1))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    same_rows([r.asDict() for r in winnow.op4(df).collect()], oracle(winnow.OP4_SQL, documents=table))
    assert winnow.dedup_lines(df).columns == ["doc_id", "text", "doc_hash", "n_lines", "n_deleted"]
    assert winnow.op4(df.limit(0)).count() == 0


def test_guarantee_for_wider_windows(spark):
    """Every run of ``window`` lines that occurred before is gone, and nothing that did not."""
    rng = random.Random(9)
    run = [f"shared line number {i} of the run" for i in range(6)]
    docs = []
    for d in range(40):
        own = [f"own {d} {i} words here too" for i in range(12)]
        at = rng.randrange(1, 11)
        docs.append((d, "\n".join(own[:at] + run + own[at:])))
    for w in (2, 3, 4, 5):
        got = {r.doc_id: r.text.split("\n") for r in winnow.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), w).collect()}
        assert set(run) <= set(got[0])
        for d in range(40):
            assert [x for x in got[d] if x.startswith("own")] == [f"own {d} {i} words here too" for i in range(12)]
            assert d == 0 or not set(run) & set(got[d]), (w, d)


def test_single_long_lines_go_wherever_they_stand(spark, sf_dir):
    """No line of five words or more that stood before is left, in made documents and in the whole table."""
    rng = random.Random(4)
    line = "a passage " + " ".join(f"word{i}" for i in range(60))
    made = [(d, "\n".join([f"own {d} {i} {rng.random()} of this text" for i in range(9)])) for d in range(60)]
    made = [(d, t.replace("\n", f"\n{line}\n", 1 + d % 5)) for d, t in made]
    for df in (spark.createDataFrame(made, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = sorted({(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()})
        got = {r.doc_id: r.text for r in winnow.dedup_lines(df).collect()}
        seen, lost = set(), 0
        for d, t in rows:
            for raw in (t or "").split("\n"):
                x = raw.strip(winnow.BLANKS)
                if len(x.replace("\t", " ").split(" ")) < 5:
                    continue
                lost += x in seen
                seen.add(x)
        left = [x for d, _ in rows for raw in (got[d] or "").split("\n") for x in [raw.strip(winnow.BLANKS)] if len(x.split()) >= 5]
        assert len(left) == len(set(left)) and lost > 0
        assert set(left) == {x for x in seen if len(x.split()) >= 5}
