"""Artifact and chunk files, sinks, and models against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import models
from lodestack.operators import evaluate
from lodestack.plans import search as plan
from lodestack.sources import artifacts as A
from lodestack.sources import chunks
from lodestack.sources import records as R


def test_ids_at_any_depth(spark):
    body = {"results": [{"papers": [{"pmid": 11}, {"pmid": "12", "judge": {"pmid": 13}}]}], "note": 'a text with "pmid": 99 in it \\', "pmid": "x", "more": [{"pmid": 14.5}, {"pmid": None}, [{"pmid": 11}]]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, "")], "id int, json string")
    got = A.ids_in_json(df, "json", "id").orderBy("id", "pos").collect()
    assert [r.pmid for r in got] == [11, 12, 13, 11]
    assert [r.pmid for r in A.distinct_ids(A.ids_in_json(df, "json", "id")).orderBy("pos").collect()] == [11, 12, 13]


def test_overlay_takes_every_field_of_the_fetched_record(spark):
    local = spark.createDataFrame([(1, "a", "b"), (2, "c", None), (3, "", "")], "pmid long, title string, abstract string")
    new = spark.createDataFrame([(2, "", "x"), (4, "d", None)], "pmid long, title string, abstract string")
    assert sorted(map(tuple, A.overlay(local, new).collect())) == [(1, "a", "b"), (2, "", "x"), (3, "", ""), (4, "d", None)]
    ids = spark.createDataFrame([(3, 0), (1, 1), (2, 2), (1, 3), (4, 4), (9, 5)], "pmid long, pos long")
    got = A.load_papers(ids, local, new)
    assert sorted((r.pmid, r.title, r.pos) for r in got.collect()) == [(1, "a", 1), (2, "c", 2), (4, "d", 4)]
    strict = A.load_papers(ids, local, new, require_abstract=True)
    assert sorted((r.pmid, r.title, r.abstract) for r in strict.collect()) == [(1, "a", "b"), (2, "", "x"), (4, "d", None)]


def test_chunk_files(spark, tmp_path):
    np.save(tmp_path / "embeds_chunk_3.npy", np.arange(10, dtype="float64").reshape(5, 2))
    (tmp_path / "pmids_chunk_3.json").write_text(json.dumps(["7", 8, 9]))
    (tmp_path / "pubmed_chunk_3.json").write_text(json.dumps([{"id": 8, "t": "Eight", "d": "20010101"}, "odd", {"d": 9, "title": "by date"}, {"pmid": 8, "t": "Eight again", "retracted": 1}, {"t": "no id"}]))
    (tmp_path / "pubmed_chunk_4.json").write_text(json.dumps({"5": {"t": "Five", "m": ["A", "B"]}, "x": {}}))
    (tmp_path / "pmids_chunk_4.json").write_text("[5]")
    np.save(tmp_path / "embeds_chunk_4.npy", np.ones((3, 2)))
    parts = chunks.read_ids(spark, f"{tmp_path}/pmids_*.json"), chunks.read_vectors(spark, f"{tmp_path}/*.npy"), chunks.read_texts(spark, f"{tmp_path}/pubmed_*.json")
    got = chunks.load_chunks(*parts).orderBy("pmid").collect()
    assert [(r.chunk, r.pos, r.pmid, r.title, r.year, r.mesh, r.retracted, r.vector) for r in got] == [
        (4, 0, 5, "Five", None, "A; B", 0, [1, 1]), (3, 0, 7, "", None, "", 0, [0, 1]), (3, 1, 8, "Eight again", None, "", 1, [2, 3]), (3, 2, 9, "by date", None, "", 0, [4, 5])]
    assert chunks.load_chunks(*parts, most=1).count() == 2
    folder = f"{tmp_path}/tables"
    chunks.init_tables(spark, folder)
    chunks.write_vectors(chunks.load_chunks(*parts), folder)
    chunks.write_vectors(chunks.load_chunks(*parts), folder)
    chunks.init_tables(spark, folder)
    assert chunks.repeated_vectors(spark.read.parquet(f"{folder}/vectors")).count() == 4
    report = {r.check: (r.value, r.status) for r in chunks.build(spark, chunks.load_chunks(*parts), spark.createDataFrame([(5, 1, 0.5)], chunks.TABLES["citations"]), folder).collect()}
    assert report["papers"] == (4.0, "pass") and report["vectors"] == (4.0, "pass") and report["overall"][1] == "warn"


def test_chunk_numbers(spark):
    of = lambda w: [r.chunk for r in A.chunk_ids(spark, w).orderBy("pos").collect()]
    assert of("3,1,3") == [3, 1] and of("7-5") == [5, 6, 7] and len(of("all")) == 38
    with pytest.raises(ValueError):
        A.chunk_ids(spark, "38")


def test_requests_of_bounded_size(spark):
    ids = spark.range(1000).selectExpr("id % 700 as pmid", "id as pos")
    got = [r.pmids for r in A.batches(ids, 100).collect()]
    assert sorted(x for b in got for x in b) == list(range(700)) and max(map(len, got)) == 100


def test_artifacts_round_trip(spark, tmp_path):
    rows = [(1, "q one", 1, 5, 'A "quoted" title', 2001, 0.5, "See [5]."), (1, "q one", 2, 6, "B", None, 0.25, "See [5]."), (2, "q two", 1, 5, "A", 2001, 0.5, None)]
    df = spark.createDataFrame(rows, "question_id long, question string, pos int, pmid long, title string, year int, score double, answer string")
    A.as_artifact(df).select("json").coalesce(1).write.text(f"{tmp_path}/a")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/a").collect()]
    (tmp_path / "all.json").write_text(json.dumps({"results": lines}))
    back = R.read_results(spark, f"{tmp_path}/all.json")
    assert sorted((r.question, r.pos, r.pmid) for r in back.collect()) == [("q one", 1, 5), ("q one", 2, 6), ("q two", 1, 5)]
    assert next(x for x in lines if x["question"] == "q one")["papers"][0]["title"] == 'A "quoted" title'
    notes = spark.createDataFrame([(1, 6, "n6"), (1, 5, "n5")], "question_id long, pmid long, note string")
    full = df.withColumns({"journal": F.lit("J"), "pubtypes": F.lit("")})
    made = json.loads(A.evidence_notes(full, notes, F.lit("topic")).first().json)
    assert made["paper_count"] == 2 and [n["note"] for n in made["notes"]] == ["n5", "n6"] and made["topic"] == "topic"


def test_report_lines(spark, tmp_path):
    run = spark.createDataFrame([(1, 5, 1, 3, 0.2), (1, 6, 2, None, 0.5), (1, 7, 3, 90, 0.9)], "question_id long, pmid long, pos int, citation_count int, impact double")
    A.write_lines(A.report_lines(evaluate.citation_audit(run), evaluate.flagged(run)), f"{tmp_path}/r")
    got = [r.value for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert sorted(got) == sorted(["| 1 | 46.5 | 0.50 | 2 | 1 | 7 |", "- `5` impact_score=0.20 cites=3", "- `6` impact_score=0.50 cites=n/a"])


def paper(spark, n, abstract="It lowered risk."):
    return spark.createDataFrame([(1, "Does it work?", i, 10000 + i, f"Title {i}", abstract, 2000 + i, "J", "Review") for i in range(n)], "question_id long, question string, pos int, pmid long, title string, abstract string, year int, journal string, pubtypes string")


def test_judge_keeps_rows_that_fail(spark):
    def fails(prompts):
        if any("Title 1" in p for p in prompts):
            raise RuntimeError("no")
        return ['{"relevance": 3, "evidence_type": "cohort"}' for _ in prompts]

    got = {r.pmid: r for r in models.judge(paper(spark, 3), fails).collect()}
    assert got[10001].error == "RuntimeError: no" and got[10001].relevance is None and got[10001].evidence_type is None
    assert all(got[p].relevance == 3 and got[p].evidence_type == "cohort" and got[p].error is None for p in (10000, 10002))


def test_summaries_map_when_there_are_many(spark):
    few, many = (models.summarize(paper(spark, n)).first() for n in (3, 12))
    assert not few.mapped and few.n_papers == 3 and "[10000]" in few.summary
    assert many.mapped and many.n_papers == 12
    seen = []
    wrong = models.notes(paper(spark, 1), lambda ps: [f"As [99999] says, and 10000 too. {len(p)}" for p in ps]).first().note
    assert "[10000]" in wrong and "99999" in wrong and "WARNING" in wrong
    assert models.summarize(paper(spark, 2), map_reduce=True).first().mapped and not seen


def test_prompts_cut_long_abstracts(spark):
    df = paper(spark, 1, "x" * 7000)
    assert df.select(models.paper_block().alias("b")).first().b.endswith("x" * 10 + models.CUT)
    assert len(df.select(models.judge_block().alias("b")).first().b) < 6200
    p = df.select(models.answer_prompt(F.col("question"), models.paper_block(10)).alias("p")).first().p
    assert p.startswith("Question: Does it work?") and "[10000] (2000, J; types=Review)\nTitle: Title 0\nAbstract: xxxxxxxxxx..." in p


def test_encoder_is_made_once_a_worker_and_gives_unit_vectors(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "pmid long, title string").withColumn("abstract", F.lit(None).cast("string"))
    got = {r.pmid: r.vector for r in models.encode(df, models.article_text(), factory, size=2).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / 10**0.5, atol=1e-6) and np.allclose(got[2], [0, 1])


def test_keyword_model(spark):
    terms = models.keywords(lambda qs: ["Statin therapy, type 2 diabetes!" if "statin" in q else "" for q in qs])
    df = spark.createDataFrame([(1, "do statins help in diabetes"), (2, "metformin against cancer")], "id int, question string")
    got = {r.id: r.t for r in df.select("id", terms(F.col("question")).alias("t")).collect()}
    assert got[1] == ["type 2 diabetes", "statin therapy"] and got[2] == ["metformin", "against"] or got[2][0] == "metformin"
    assert plan.Keywords


def test_requests():
    assert models.check_request("why?")["top"] == 10
    for bad in ({"question": "a"}, {"question": "why?", "top": 26}, {"question": "why?", "context": 0}):
        with pytest.raises(ValueError):
            models.check_request(**bad)


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "pmid long, title string")
    new = spark.createDataFrame([(2, "first", 1), (2, "last", 2), (3, "c", None)], "pmid long, title string, turn int")
    assert sorted(map(tuple, R.upsert(old, new, order="turn").collect())) == [(1, "a"), (2, "last"), (3, "c")]
    assert sorted(map(tuple, R.upsert(old, old.limit(0)).collect())) == [(1, "a"), (2, "b")]
    full = spark.createDataFrame([(1, "t", "a", "j", 2000, "m", "p", 0)], R.PAPER)
    fresh = spark.createDataFrame([(1, "", None, "k", None, "", "q", 1)], R.PAPER)
    assert tuple(R.enrich(full, fresh, replace=True).first()) == (1, "", None, "k", None, "", "q", 1)
