import numpy as np

from lodestack.llm import topk


def test_whole_table(spark, sf_dir, oracle, same_rows):
    got = [r.asDict() for r in topk.op1(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()]
    same_rows(got, oracle(topk.OP1_SQL))


def test_many_blocks_ties_and_odd_rows(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("GROUP", 5), ("PIVOTS", 6), ("RINGS", 4), ("NEAREST", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6))
    vectors = [(i, [float(x) for x in centres[i % 5] + 0.1 * rng.normal(size=6)]) for i in range(600)]
    vectors += [(i, [0.5] * 6) for i in range(600, 900)] + [(600, [0.5] * 6)] * 20 + [(50, [1.0] * 6)]
    odd = [(1000, None), (1001, [float("nan")] + [1.0] * 5), (1002, [None] + [1.0] * 5), (1050, []), (None, [9.0] * 6), (1100, [9.0] * 7), (1150, [float("inf")] * 6)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("id", topk.F.lit("x"))
    x = {(i, tuple(np.floor(256 * np.array(v)).astype(int).tolist())) for i, v in vectors}
    want = []
    for q in sorted({i for i, _ in x if i % 50 == 0}):
        scores = {(int(np.dot(a, b)), i) for j, a in x if j == q for i, b in x if i != q}
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:5])]
    assert sorted(map(tuple, topk.op1(df).collect())) == want
    assert topk.op1(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.op1(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_bounds_leave_far_annuli_out(spark):
    """Of vectors in clusters a query visits a small share, and the result is that of all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32)) * 4
    x = np.concatenate([c + 0.05 * rng.normal(size=(150, 32)) for c in centres])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    visits = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, topk.top_k(df, topk.F.col("id") % 50 == 0, 5, visits=visits).collect()))
    v = np.floor(256 * x).astype(int)
    want = []
    for q in range(0, len(x), 50):
        s = v @ v[q]
        near = [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:5]
        want += [(q, r + 1, i, int(s[i])) for r, i in enumerate(near)]
    assert got == want
    assert visits.value < 0.3 * len(x) * len(range(0, len(x), 50))


def test_bounds_hold(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(3000, 8)) * 300).astype(np.int64)
    pivots = topk.Pivots.choose(x[:500], 6, 4)
    cells, _ = pivots.cells(x)
    d = topk.distances(x, pivots.points)
    kinds = np.unique(cells)
    annuli = topk.Annuli(kinds, np.array([d[cells == c].min(axis=0) for c in kinds]), np.array([d[cells == c].max(axis=0) for c in kinds]), np.array([(x[cells == c].astype(float) ** 2).sum(axis=1).max() for c in kinds]))
    bound = annuli.bounds(x[:200], pivots)
    for j, c in enumerate(kinds):
        assert (bound[:, j] >= (x[:200] @ x[cells == c].T).max(axis=1)).all()


def test_long_vectors_and_large_components(spark):
    rows = [(i, [float((i * 7 + j) % 11) * (1e9 if i % 2 else 1.0) for j in range(5000)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.floor(256 * np.array(v)).astype(object) for i, v in rows}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op1(df.filter("vec_id % 2 = 0")).collect()}
    for q in (0, 50):
        best = sorted(((-int((x[q] * x[i]).sum()), i) for i in x if i != q and i % 2 == 0))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
