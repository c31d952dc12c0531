import math
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import masked_lm as M


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    """Documents, their codes, vocabulary and trained network."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = M.Vocabulary.of(M.word_counts(docs))
    codes = M.checkpoint(M.encoded(docs, vocabulary, ["doc_id"]))
    return docs, codes, vocabulary, M.fit(codes, vocabulary)


def plain_log_prob(network, leaves, i):
    """One token's log-probability, computed on its own."""
    w = network.weights
    pad = [M.EDGE] * M.REACH
    line = pad + [int(x) for x in leaves] + pad
    context = line[i : i + M.REACH] + line[i + M.REACH + 1 : i + 2 * M.REACH + 1]
    h = np.tanh(np.concatenate([w["embed"][c] for c in context]).astype(float) @ w["w1"] + w["b1"])
    cluster, leaf = divmod(line[i + M.REACH], M.LEAVES)
    total = 0.0
    for z, k in ((h @ w["w2"] + w["b2"], cluster), (h @ w["w3"][cluster] + w["b3"][cluster], leaf)):
        total += z[k] - np.log(np.exp(z).sum())
    return total


def test_whole_table_against_a_plain_version(model):
    """Vocabulary, shares and scores of every document, token by token, from Python counters; only the weights are given."""
    docs, codes, vocabulary, network = model
    rows = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    counts = Counter(w for words in rows.values() for w in words)
    own = sorted(counts, key=lambda w: (-counts[w], M.word_hash(w)))[: M.FREQUENT]
    leaf = {w: i for i, w in enumerate(sorted(own, key=lambda w: (M.ending(w), M.word_hash(w))))}
    total = Counter()
    for w, n in counts.items():
        if w not in leaf:
            total[M.ending(w)] += n
    got = {r.doc_id: r for r in M.op9(docs).collect()}
    for d, words in rows.items():
        leaves = [leaf.get(w, M.FREQUENT + M.ending(w)) for w in words]
        shares = sum(math.log(counts[w] / total[M.ending(w)]) for w in words if w not in leaf)
        assert got[d].n_tokens == len(words)
        want = sum(plain_log_prob(network, leaves, i) for i in range(len(words))) + shares
        assert np.isclose(got[d].log_prob, want, rtol=2e-4, atol=1e-3), d


def test_unknown_words_get_their_shares_by_the_join(spark, model, monkeypatch):
    docs, *_ = model
    whole = {r.doc_id: r.log_prob for r in M.op9(docs).collect()}
    monkeypatch.setattr(M, "KNOWN", 40)
    few = {r.doc_id: r.log_prob for r in M.op9(docs).collect()}
    assert len(M.Vocabulary.of(M.word_counts(docs)).hashes) <= 40
    # fewer words have leaves of their own, so scores differ; shares of one leaf and the sum over the corpus are proper
    assert whole.keys() == few.keys() and all(math.isfinite(x) for x in few.values())
    pair = spark.createDataFrame([(1, "zaq wsx zaq"), (2, "zaq wsx wsx")] + [(10 + i, " ".join(f"f{j}" for j in range(60))) for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: r for r in M.op9(pair).collect()}
    vocabulary = M.Vocabulary.of(M.word_counts(pair))
    assert not {M.word_hash("zaq"), M.word_hash("wsx")} & set(vocabulary.hashes.tolist())
    rows = {r.doc_id: r for r in M.encoded(pair, vocabulary, ["doc_id"]).collect()}
    assert sorted(rows[1].rare) == sorted(M.word_hash(w) for w in "zaq wsx zaq".split())
    assert all(math.isfinite(r.log_prob) and r.log_prob < 0 for r in got.values())


def test_beats_a_bigram_model_on_held_out_text(spark):
    """Trained in several copies on nine of ten documents, it predicts the tenth better than interpolated bigrams do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(2, "doc_id")
    vocabulary = M.Vocabulary.of(M.word_counts(docs))
    codes = M.checkpoint(M.encoded(docs, vocabulary, ["doc_id"]))
    network = M.fit(codes.filter("doc_id % 10 <> 0"), vocabulary)
    rows = codes.select("doc_id", "leaves").collect()
    read = lambda held: [np.frombuffer(r.leaves, dtype=np.int16).astype(int) for r in rows if (r.doc_id % 10 == 0) == held]
    unigram = np.bincount(np.concatenate(read(False)), minlength=M.CLASSES) + 0.5
    unigram /= unigram.sum()
    pairs = Counter(p for x in read(False) for p in zip([M.EDGE, *x[:-1].tolist()], x.tolist(), strict=True))
    left, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        left[a] += n
        kinds[a] += 1

    def bigram(a, b):
        return (max(pairs[a, b] - 0.75, 0) + 0.75 * kinds[a] * unigram[b]) / left[a] if left[a] else unigram[b]

    tests = [x for x in read(True) if len(x)]
    want = np.mean([math.log(bigram(a, b)) for x in tests for a, b in zip([M.EDGE, *x[:-1].tolist()], x.tolist(), strict=True)])
    plain = np.mean(np.log(unigram[np.concatenate(tests)]))
    got = network.log_probs(*M.windows(tests)).mean()
    assert got > want > plain


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    target, context = rng.integers(0, M.CLASSES, 40).astype(np.int16), rng.integers(0, M.CLASSES + 1, (40, 2 * M.REACH)).astype(np.int16)
    start = M.Network({k: rng.normal(size=s).astype(np.float32) * 0.3 for k, s in M.SHAPES.items()})
    squares = M.Network({k: np.full(s, 1e12, dtype=np.float32) for k, s in M.SHAPES.items()})
    moved = M.Network.of(start.vector())
    M.Learner(moved, squares, rate=1e6).step(target, context)  # a plain gradient step, as the squares hardly change
    for k in M.SHAPES:
        grad = start.weights[k] - moved.weights[k]
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        losses = []
        for sign in (1, -1):
            near = M.Network({n: w.astype(float).copy() for n, w in start.weights.items()})
            near.weights[k][at] += sign * 1e-3
            losses.append(-near.log_probs(target, context).sum())
        assert np.isclose((losses[0] - losses[1]) / 2e-3, grad[at], rtol=0.05, atol=0.02), k
    assert np.array_equal(M.Network.of(start.vector()).vector(), start.vector())


def test_documents_that_occur_twice_score_apart(spark):
    """Copies planted among the documents score above what they score when they stand once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 1000 and 4000").select("doc_id", "text")
    twice = docs.filter("doc_id % 20 = 3").withColumn("doc_id", M.F.col("doc_id") + 10**6)
    once = {r.doc_id: r.mean_log_prob for r in M.op9(docs).collect()}
    both = {r.doc_id: r.mean_log_prob for r in M.op9(docs.unionByName(twice)).collect()}
    moved = lambda ids: np.array([both[d] - once[d] for d in ids])
    planted = [d - 10**6 for d in both if d >= 10**6]
    others = [d for d in once if d not in set(planted)]
    assert (moved(planted) > np.quantile(moved(others), 0.95)).mean() > 0.8


def test_counts_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b a", 3), (None, "a b a", 3), (2, "long " * 100_000, 4)], "doc_id long, text string, row int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.mean_log_prob is None) for r in M.op9(docs).collect())
    assert got == [(0, 3, False), (0, 3, False), (1, 0, True), (1, 0, True), (2, 100_000, False)]
    assert M.op9(docs.limit(0)).count() == 0
    assert {r.wh: r.n for r in M.word_counts(docs).collect()} == {M.word_hash("a"): 4, M.word_hash("b"): 2, M.word_hash("long"): 100_000}
    assert spark.sql("select xxhash64('é b') h").first().h == M.word_hash("é b")


def test_every_window_is_trained_on_once():
    sizes = [1, 3, 7, 0, 2, 1, 1000]
    seen = np.zeros(sum(sizes), dtype=int)
    for round_ in range(len(M.ROUNDS)):
        n = 0
        for size in sizes:
            seen[n + M.picked(n, size, round_)] += 1
            n += size
    assert (seen == 1).all()
