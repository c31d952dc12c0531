import zlib

import numpy as np

from lodestack.llm import quality


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    model = quality.Chain(rng.normal(size=4), rng.normal(size=(2, 2)))
    counts = np.array([3, 1, 5])
    x = rng.normal(size=(9, 4))
    p, moves, log_z = model.marginals(x, counts)
    at, z_sum, seen = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        score = x[at : at + n] @ model.emit
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        w = np.array([np.exp(sum(score[i] * y[i] for i in range(n)) + sum(model.move[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        assert np.allclose(p[at : at + n], [sum(v for v, y in zip(w, paths) if y[i]) / w.sum() for i in range(n)])
        for v, y in zip(w, paths):
            for a, b in zip(y, y[1:]):
                seen[a, b] += v / w.sum()
        z_sum += np.log(w.sum())
        at += n
    assert np.allclose(moves, seen) and np.isclose(log_z, z_sum)


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op5(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97 and np.mean([(s >= 0.5) == y for s, y in pairs]) > 0.93


def test_labels_of_the_held_out_third_are_never_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", quality.F.when(quality.fold(quality.F.col("doc_id")) == 1, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert sorted(quality.op5(docs, labels).collect()) == sorted(quality.op5(docs, flipped).collect())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x\n\n\x00y"), (2, "w " * 30000), (2, "w " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    got = quality.op5(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.score for r in quality.op5(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.op5(docs.limit(0), labels).count() == 0


def test_whole_table_against_plain_forward_backward(spark, sf_dir):
    """Every document again, line by line with scalar sums, from the fitted weights."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.op5(docs, labels).collect()}
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        own = [quality.line_features([x])[0] for x in lines]
        zero = np.zeros(quality.OWN)
        score = [float(np.concatenate([own[i], own[i - 1] if i else zero, own[i + 1] if i + 1 < len(own) else zero]) @ model.emit) for i in range(len(own))]
        move = np.exp(model.move)
        ahead, back = [np.array([1.0, np.exp(score[0])])], [np.ones(2)]
        for s in score[1:]:
            a = ahead[-1] @ move * np.array([1.0, np.exp(s)])
            ahead.append(a / a.sum())
        for s in score[:0:-1]:
            b = move @ (np.array([1.0, np.exp(s)]) * back[-1])
            back.append(b / b.sum())
        good = [a[1] * b[1] / (a @ b) for a, b in zip(ahead, back[::-1], strict=True)]
        weight = np.array([len(x) + 1.0 for x in lines])
        mean = np.clip((np.array(good) * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        z = model.scale[0] * np.log(mean / (1 - mean)) + model.scale[1]
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-z)), atol=1e-6), r.doc_id


def test_further_columns_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.withColumns({"quality": quality.F.lit(1), "score": quality.F.lit("x"), "held_out": quality.F.lit(None)})
    assert sorted(quality.op5(more, labels.withColumn("text", quality.F.lit("y"))).collect()) == sorted(quality.op5(docs, labels).collect())
