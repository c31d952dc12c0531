"""Greedy passes, readers and the stream against plain versions."""

import gzip
import json
import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import models
from lodestack.config import Settings
from lodestack.functions import stem
from lodestack.operators import context, dense, evidence, index
from lodestack.sources import records as R
from lodestack.streaming.ingest import ingest


def test_greedy_dedup_matches_plain_walk(spark):
    titles = ["Alpha beta gamma delta", "alpha  beta gamma delta!", "Alpha beta gamma deltas", "Epsilon zeta", "", "short", "Zeta epsilon", "Wholly different words here"]
    rows = [(1, i, i, False, t, "an abstract that is longer than forty characters, easily" if t != "short" else "") for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "question_id long, pmid long, rank int, clinical boolean, title string, abstract string")
    kept = []
    for _, pmid, _, _, t, a in rows:
        n = " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
        toks = {w for w in n.split() if len(w) > 2}
        if not n or len(n) < 8 and len(a) < 40:
            continue
        if any(n == k or len(toks & kt) / max(1, len(toks | kt)) >= 0.8 or SequenceMatcher(None, n, k).ratio() >= 0.92 for _, k, kt in kept):
            continue
        kept.append((pmid, n, toks))
    got = [r.pmid for r in context.greedy_dedup(df, top_n=10).orderBy("kept_rank").collect()]
    assert got == [k[0] for k in kept] == [0, 3, 7]
    assert [r.pmid for r in context.greedy_dedup(df, top_n=1).orderBy("kept_rank").collect()] == [0, 3]


def pairs(spark, question, papers):
    rows = [(1, question, i, i, t, a, p, s, 0.1) for i, (t, a, p, s) in enumerate(papers)]
    return spark.createDataFrame(rows, "question_id long, question string, pmid long, rank int, title string, abstract string, pubtypes string, score double, impact double")


def test_selection_rules(spark):
    q = "Does metformin reduce cancer risk in adults?"
    papers = [("Metformin cohort of adults and cancer risk", "", "", 1.0), ("Metformin cohort of adults and cancer risk.", "", "", 0.9), ("Cancer risk in adults", "", "", 2.0), ("Metformin in children", "", "", 1.0), ("Metformin review of cancer risk, adults", "no significant effect", "Review", 0.5), ("Metformin pathway in mouse cell lines", "", "", 0.9)]
    got = [r.pmid for r in evidence.select_evidence(pairs(spark, q, papers)).orderBy("selected_pos").collect()]
    assert got[0] == 0 and 4 in got and not {2, 3} & set(got)
    none = evidence.select_evidence(pairs(spark, q, papers).limit(0))
    assert none.count() == 0
    few = evidence.select_evidence(pairs(spark, q, papers), Settings(max_selected=0))
    assert few.count() == 0
    cinv = "treatment of chemotherapy nausea"
    papers = [("Ondansetron for chemotherapy nausea", "", "Randomized Controlled Trial", 1.0), ("Ginger for nausea", "", "", 1.0), ("Acupressure for chemotherapy vomiting", "", "", 0.9), ("Massage and chemotherapy", "", "", 0.8)]
    got = [r.pmid for r in evidence.select_evidence(pairs(spark, cinv, papers)).orderBy("selected_pos").collect()]
    assert got[0] == 0 and len(got) == 2


def test_bm25_of_a_small_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "gamma"), (4, None)], "pmid long, title string").withColumn("abstract", F.lit(None).cast("string"))
    terms = spark.createDataFrame([(7, "beta"), (7, "beta"), (7, "gamma"), (8, "nothing")], "question_id long, term string")
    for built in (index.Lexical.build(docs, f"{tmp_path}/i", False), index.Lexical.open(spark, f"{tmp_path}/i", False)):
        assert sorted((r.question_id, r.pmid, r.pos) for r in built.bm25(terms, 5).collect()) == [(7, 1, 2), (7, 3, 1)]
    groups = spark.createDataFrame([(7, 0, "alpha"), (7, 1, "beta"), (7, 1, "gamma"), (8, 0, "alpha")], "question_id long, group_no int, term string")
    assert [(r.question_id, r.pmid) for r in built.bm25_strict(groups, 5).collect()] == [(7, 1)]


def test_only_the_asked_buckets_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "pmid long, title string").withColumn("abstract", F.lit(""))
    built = index.Lexical.build(docs, f"{tmp_path}/i", False)
    found = built.bm25(spark.createDataFrame([(1, "word5")], "question_id long, term string"), 5)
    assert [r.pmid for r in found.collect()] == [5]
    held = len(list((tmp_path / "i" / "postings").glob("bucket=*")))
    assert held > 32 and re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", found._jdf.queryExecution().toString())


def test_stemmed_index_against_a_plain_one(spark, sf_dir):
    """Tokens of any script without accents, by their stems; scores by the formula."""
    from lodestack import queries

    def plain(text):
        low = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()
        return [stem.stem(w) for w in re.findall(r"[^\W_]+", low)]

    papers = {r.pmid: Counter(plain(f"{r.title} {r.abstract}")) for r in queries.view(spark, sf_dir, "papers").collect()}
    length = {p: sum(c.values()) for p, c in papers.items()}
    mean, df = sum(length.values()) / len(length), Counter(t for c in papers.values() for t in c)
    got = {}
    for r in queries.QUERIES["bm25_stemmed_topk"](spark, sf_dir).collect():
        got.setdefault(r.question_id, []).append((r.pos, r.pmid, r.score))
    probes = {-1 - r.question_id: r.terms for r in queries.view(spark, sf_dir, "probes").select("question_id", queries.T.query_terms("question").alias("terms")).collect()}
    for q, terms in probes.items():
        want = {}
        for t in {stem.stem(t) for t in terms}:
            idf = max(1e-6, math.log((len(papers) - df[t] + 0.5) / (df[t] + 0.5))) if df[t] else 0
            for p, c in papers.items():
                if c[t]:
                    want[p] = want.get(p, 0) + idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[p] / mean))
        best = sorted(((-round(s, 6), p) for p, s in want.items()))[:100]
        assert [p for _, p, _ in sorted(got.get(q, []))] == [p for _, p in best], q
    assert any(got.get(q) for q in probes)


@pytest.mark.parametrize(("word", "stemmed"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("statins", "statin"), ("oscillators", "oscil"), ("generalizations", "gener")])
def test_stems(word, stemmed):
    assert stem.stem(word) == stemmed


def test_dense_blocks_and_cells(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "pmid long, vector array<float>")
    q = df.where("pmid < 20").select(F.col("pmid").alias("question_id"), "vector")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    u = v.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {i: set(np.argsort(-np.round(u @ u[i], 6), kind="stable")[:5].tolist()) for i in range(20)}
    got = dense.dense(q, df, 5)
    by = {}
    for r in got.collect():
        by.setdefault(r.question_id, set()).add(r.pmid)
    assert by == want
    assert dense.recall(dense.ivf(q, df, 5, 4, 4), got).first().recall == 1.0
    assert dense.recall(dense.ivf(q, df, 5, 8, 3), got).first().recall > 0.5


XML = """<?xml version="1.0"?><Set><PubmedArticle><MedlineCitation><PMID Version="1">123</PMID><Article><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="AIM">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><PublicationTypeList><PublicationType>Retracted Publication</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName>M1</DescriptorName></MeshHeading><MeshHeading><DescriptorName>M2</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>x</PMID></MedlineCitation></PubmedArticle></Set>"""


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(XML)
    assert [tuple(r) for r in R.read_articles(spark, f"{tmp_path}/a.xml.gz").collect()] == [(123, "A title", "AIM: One. Two.", "J", 2001, "M1; M2", "Retracted Publication", 1)]
    np.save(tmp_path / "v.npy", np.arange(6, dtype="float32").reshape(3, 2))
    assert [(r.pos, r.vector) for r in R.read_npy(spark, f"{tmp_path}/v.npy").orderBy("pos").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    (tmp_path / "m.json").write_text(json.dumps({"5": {"t": "T", "d": "19991231", "pt": ["A", "B"]}, "6": "odd", "x": {}}))
    got = R.text_records(R.text_map(spark, f"{tmp_path}/m.json"), "record").orderBy("pmid").collect()
    assert [(r.pmid, r.title, r.year, r.pubtypes) for r in got] == [(5, "T", 1999, "A; B"), (6, "", None, "")]
    (tmp_path / "q.txt").write_text("# c\n\n one? \ntwo?\n")
    assert [r.question for r in R.read_questions(spark, f"{tmp_path}/q.txt").collect()] == ["one?", "two?"]
    for n, body in enumerate((["a", "b"], {"questions": ["a", "b"]}, [{"question": "a"}, {"question": "b"}])):
        (tmp_path / f"q{n}.json").write_text(json.dumps(body))
        assert [r.question for r in R.read_questions(spark, f"{tmp_path}/q{n}.json").collect()] == ["a", "b"]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"question": "a", "papers": [{"pmid": 1, "score": 0.5}]}, {"question": "a", "papers": [{"pmid": 2}, {"pmid": 3}]}]}))
    assert [(r.pos, r.pmid) for r in R.read_results(spark, f"{tmp_path}/r.json").orderBy("pos").collect()] == [(1, 2), (2, 3)]


@pytest.mark.parametrize(("raw", "year"), [("20240115", 2024), ("1799", None), ("abcd", None), (None, None), ("199", None), ("2200x", 2200)])
def test_coerce_year(spark, raw, year):
    assert spark.range(1).select(R.coerce_year(F.lit(raw).cast("string")).alias("y")).first().y == year


def test_stream_upserts(spark, tmp_path):
    rec = lambda *rows: spark.createDataFrame([(i, t, "", None, None, "", "", 0) for i, t in rows], R.PAPER)
    rec((1, "a"), (2, "b")).write.parquet(f"{tmp_path}/in/x1")
    source = f"{tmp_path}/in/*"
    ingest(spark, source, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination(60)
    rec((2, "new"), (3, "c")).write.parquet(f"{tmp_path}/in/x2")
    ingest(spark, source, f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination(60)
    assert sorted((r.pmid, r.title) for r in spark.read.parquet(f"{tmp_path}/table/v=1").collect()) == [(1, "a"), (2, "new"), (3, "c")]


def test_stream_encodes_and_forgets(spark, tmp_path):
    rec = lambda *rows: spark.createDataFrame([(i, t, a, None, None, "", "", 0) for i, t, a in rows], R.PAPER)
    for n, rows in enumerate(([(1, "a", "text one"), (2, "b", "")], [(1, "new", "text two"), (3, "c", "text")], [(4, "d", "more")], [(5, "e", "over")])):
        rec(*rows).coalesce(1).write.parquet(f"{tmp_path}/in/x{n}")
        ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/table", f"{tmp_path}/check", lambda: models.hashed_vectors, limit=3).awaitTermination(60)
    assert sorted(p.name for p in (tmp_path / "table").glob("v=*")) == ["v=2", "v=3"]
    assert sorted((r.pmid, r.title) for r in spark.read.parquet(f"{tmp_path}/table/v=3").collect()) == [(1, "new"), (3, "c"), (4, "d")]
    vectors = spark.read.parquet(f"{tmp_path}/table/vectors")
    assert sorted((r.b, r.pmid) for r in vectors.collect()) == [(0, 1), (1, 1), (1, 3), (2, 4)]


def test_registered_walks_see_every_paper(spark, sf_dir, monkeypatch):
    from lodestack import queries

    seen = {}
    for module, name in ((context, "greedy_dedup"), (evidence, "select_evidence")):
        monkeypatch.setattr(module, name, lambda df, *a, _n=name, **k: seen.setdefault(_n, df).withColumn("kept_rank", F.lit(1)))
        queries.QUERIES[name](spark, sf_dir)
    papers = queries.view(spark, sf_dir, "papers").count()
    for name, most in (("greedy_dedup", queries.DEDUPED_FROM), ("select_evidence", queries.SELECTED_FROM)):
        assert seen[name].select("pmid").distinct().count() == papers
        assert seen[name].groupBy("question_id").count().agg(F.max("count")).first()[0] <= most
    assert seen["select_evidence"].count() == queries.ruled(spark, sf_dir).count()


def test_xml_carries_whole_abstracts(spark, sf_dir):
    from lodestack import queries

    got = {r.pmid: r.abstract for r in R.parse_articles(queries.article_xml(spark, sf_dir), "xml").collect()}
    want = {r.pmid: r.abstract for r in queries.view(spark, sf_dir, "papers").collect()}
    assert set(got) == set(want) and max(map(len, want.values())) > 1000
    for k, a in want.items():
        body = (a or "").strip(" ")
        assert got[k] == (f"AIM: {body} End." if body else "End."), k


def test_recall_of_the_index_is_registered(spark, sf_dir):
    from lodestack import queries

    v, q = queries.view(spark, sf_dir, "vectors"), queries.asked(spark, sf_dir).select("question_id", "vector")
    exact = {(r.question_id, r.pmid) for r in dense.dense(q, v, 10).collect()}
    asked = {i for i, _ in exact}
    rows = sorted(queries.QUERIES["ivf_recall"](spark, sf_dir).collect(), key=lambda r: r.probes)
    c = queries.cells(spark, sf_dir)
    assert rows[-1].probes == len(c.centres) and rows[-1].recall == 1.0
    for r in rows[:2]:
        found = {(x.question_id, x.pmid) for x in c.search(q, 10, r.probes).collect()}
        share = [len({p for p in exact if p[0] == i} & found) / sum(p[0] == i for p in exact) for i in asked]
        assert r.n_questions == len(asked) and abs(r.recall - sum(share) / len(share)) < 1e-5
