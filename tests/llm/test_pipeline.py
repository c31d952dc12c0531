"""Each stage of the pipeline against a plain version of its operator, on the stage's own input."""

import pyarrow as pa
import pytest

import corpus_pipeline as P
from lodestack.llm import decontam, mixing, quality, winnow
from test_decontam import edits_anywhere
from test_simhash import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, input rows, output rows) of every stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        made = stage(spark, docs, sf_dir)
        rows = made.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, made.schema)
    return {n: (a, b) for n, a, b in out}


def table(rows):
    return pa.Table.from_pylist([r.asDict() for r in rows])


def test_quality(spark, sf_dir, stages):
    before, after = stages["quality"]
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.scores([r.text])[0] >= 0.5}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert sum(q == 1 and d in kept for d, q in truth.items()) >= 0.97 * sum(q == 1 for q in truth.values())
    assert sum(q == 0 and d in kept for d, q in truth.items()) <= 0.25 * sum(q == 0 for q in truth.values())


def test_lines(stages, oracle):
    before, after = stages["line_dedup"]
    want = {r["doc_id"]: r for r in oracle(winnow.OP4_SQL, documents=table(before))}
    gone = {d for d, r in want.items() if r["n_deleted"] and not r["n_chars"]}
    assert {r.doc_id for r in after} == set(want) - gone
    assert all(len(r.text) == want[r.doc_id]["n_chars"] for r in after)


def resolved(before, after):
    """Against a walk over all pairs of texts: pairs of different texts of similarity 0.8 or more, and how many of them are
    in one group of the stage; ids that the stage removed without such a chain of pairs, and copies that it left."""
    texts = {}
    for r in before:
        texts.setdefault(r.text or "", []).append(r.doc_id)
    pool = sorted(texts, key=lambda t: min(texts[t]))
    grams, by = [], {}
    for i, t in enumerate(pool):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        grams.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
        for g in grams[-1]:
            by.setdefault(g, []).append(i)
    common = {}
    for ids in by.values():
        for x, i in enumerate(ids):
            for j in ids[:x]:
                common[j, i] = common.get((j, i), 0) + 1
    alike = [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(grams[i]) + len(grams[j]) - n)]
    root = brute_components(range(len(pool)), alike)
    kept = {r.doc_id for r in after}
    best = {}
    for i, r in root.items():
        best[r] = min(best.get(r, 10**18), *texts[pool[i]])
    held = {i: any(d in kept for d in texts[t]) for i, t in enumerate(pool)}
    missed = [(i, j) for i, j in alike if held[i] and held[j]]
    return alike, missed, set(best.values()) - kept, kept - set(best.values())


def test_near_duplicates(stages):
    """Only pairs of different texts count: none is missed, nothing else goes."""
    before, after = stages["near_duplicates"]
    alike, missed, gone, left = resolved(before, after)
    assert not missed and not gone and not left


def test_near_duplicates_of_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alike, missed, gone, left = resolved(docs.collect(), P.near_duplicate_stage(spark, docs, "").collect())
    assert alike and not missed and not gone and not left


def test_decontamination(spark, sf_dir, stages):
    before, after = stages["decontaminate"]
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after}
    for r in before:
        text = decontam.normal(r.text)
        if any(i in text for i in items):
            assert r.doc_id not in kept
        elif r.doc_id not in kept:
            assert any(edits_anywhere(i, text) <= decontam.RATE * len(i) for i in items)
    assert len(after) < len(before)


def test_mix(stages, oracle, same_rows):
    before, after = stages["mix"]
    want = [r for r in oracle(mixing.OP8_SQL, documents=table(before)) if r["taken"]]
    same_rows([{k: r[k] for k in ("doc_id", "size", "source_size", "target", "taken")} for r in after if r.taken], want)


def test_run_and_odd_rows(spark, sf_dir, tmp_path):
    assert P.run(spark, sf_dir).count() > 20
    odd = [(1, None, None, None, None), (1, "", "en", "a", 0), (None, "x y z.\n\nx y z.", "en", "a", 1), (None, "x y z.\n\nx y z.", "en", "a", 1), (2, "long words here. " * 9000, "en", None, 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", quality.F.lit(1)).withColumn("size", quality.F.lit("x"))
    for start in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            out = stage(spark, start, sf_dir)
            assert set(P.COLUMNS) <= set(out.columns) and out.count() <= start.count()
