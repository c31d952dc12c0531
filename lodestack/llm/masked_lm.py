"""Masked pseudo-likelihood of documents under a bidirectional window network over words.

Every word of the corpus is a token of its own. The network embeds the REACH words on either side of a token, passes
them through one hidden layer and predicts the token by a two-level softmax: first one of CLUSTERS clusters, then one
of its LEAVES leaves. The most frequent words have a leaf of their own; the others share leaves by the hash of their
ending, and a word's share of such a leaf is its share of the leaf's occurrences in the corpus. A document's score is
the sum of its tokens' conditional log-probabilities. The network is written and trained in numpy.

Vocabulary, shares and weights come from all documents. Words are counted over the whole corpus. In each round every
partition trains a copy of the weights on its documents by Adagrad; the copies and their summed squares are averaged,
weighted by their windows. The first rounds are short, so that the copies stay close while they find a direction, and
each later one is twice as long; the rounds' sets of windows part all windows, so every one of every document is used
once.

What a worker holds is bounded: the weights, and the shares of the KNOWN most frequent words. The occurrences of other
words are rows, which a join with the counted words gives their shares; none of those words is frequent, so the join
has no hot key.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint, drop, small_batches

#: Clusters of the first softmax, leaves of each, and clusters whose leaves are words of their own.
CLUSTERS, LEAVES, OWN_CLUSTERS = 64, 64, 48
FREQUENT, SHARED = OWN_CLUSTERS * LEAVES, (CLUSTERS - OWN_CLUSTERS) * LEAVES
CLASSES = CLUSTERS * LEAVES
#: What stands beyond a text's ends.
EDGE = CLASSES
REACH, WIDTH, HIDDEN = 2, 8, 24
#: The rounds of training, each by the windows it uses: those from .. to of every CYCLE windows of a partition.
CYCLE = 64
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8), (8, 16), (16, 32), (32, 64))
RATE = 0.15
#: Windows of a gradient step: from FIRST on, growing with the windows that a partition has seen, up to BATCH.
FIRST, BATCH = 1024, 8192
#: Tokens scored at once, words a worker remembers, words counted in a worker before the counts are handed on.
BLOCK, REMEMBERED, COUNTED = 16384, 400_000, 500_000
#: Most words whose shares are sent to every worker.
KNOWN = 1 << 18
SHAPES = {"embed": (CLASSES + 1, WIDTH), "w1": (2 * REACH * WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLUSTERS), "b2": (CLUSTERS,), "w3": (CLUSTERS, HIDDEN, LEAVES), "b3": (CLUSTERS, LEAVES)}
#: Weights of one row when copies are averaged.
ROW = 64


def word_hash(word: str) -> int:
    """XXH64 of a word as a signed number, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class Endings(dict):
    """Number of an ending of two characters."""

    def __missing__(self, end: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[end] = n = zlib.crc32(end.encode("utf-8", "surrogatepass")) % SHARED
        return n


ENDINGS = Endings()


def ending(word: str) -> int:
    return ENDINGS[word[-2:]]


def counted(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"wh": np.fromiter(map(word_hash, seen), np.int64, len(seen)), "ending": np.fromiter(map(ending, seen), np.int16, len(seen)), "n": np.fromiter(seen.values(), np.int64, len(seen))})


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(wh: hash of the word, ending, n) over all documents: counted within tasks, then summed by word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.iloc[:, 0]:
                seen.update((t or "").split())
                if len(seen) > COUNTED:
                    yield counted(seen)
                    seen.clear()
        if seen:
            yield counted(seen)

    return docs.select(text_col).mapInPandas(count, "wh long, ending short, n long").groupBy("wh").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The known words by hash, in order, with leaf and log share of the leaf; the log totals of the shared leaves; the
    occurrences of every leaf; and the least count of a known word."""

    hashes: np.ndarray
    leaf: np.ndarray
    share: np.ndarray
    totals: np.ndarray
    leaf_counts: np.ndarray
    least: int

    @staticmethod
    def of(counts: DataFrame) -> Vocabulary:
        """From :func:`word_counts`. At most KNOWN rows reach the driver: those of the counts at or above the lowest
        step of a logarithmic scale that so many words reach."""
        step = F.floor(F.log2("n") * 16).cast("int")
        scale = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
        least, held = math.inf, 0
        for s, words in scale:
            held += words
            if held > KNOWN:
                break
            least = s
        rows = counts.filter(step >= least).select("wh", "ending", "n").toPandas() if scale and least < math.inf else pd.DataFrame({"wh": [], "ending": [], "n": []})
        wh, end, n = (rows[c].to_numpy(dtype=np.int64) for c in ("wh", "ending", "n"))
        totals = np.zeros(SHARED)
        for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
            totals[r.ending] = r.n
        top = np.lexsort((wh, -n))[:FREQUENT]
        top = top[np.lexsort((wh[top], end[top]))]  # words of one ending next to each other
        np.subtract.at(totals, end[top], n[top])
        own = np.zeros(FREQUENT)
        own[: len(top)] = n[top]
        leaf = FREQUENT + end
        leaf[top] = np.arange(len(top))
        with np.errstate(divide="ignore"):
            logs = np.log(totals)
        share = np.where(leaf < FREQUENT, 0.0, np.log(np.maximum(n, 1)) - np.where(np.isfinite(logs[end]), logs[end], 0.0))
        order = np.argsort(wh)
        least_n = 0 if least is math.inf else int(n.min()) if len(n) else 0
        return Vocabulary(wh[order], leaf[order].astype(np.int16), share[order], logs, np.concatenate([own, totals]), least_n)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, log share, hash and whether it is known, of each word. The log share of an unknown word lacks the
        logarithm of its count."""
        wh = np.fromiter(map(word_hash, words), np.int64, len(words))
        end = np.fromiter(map(ending, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.hashes, wh), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == wh if len(self.hashes) else np.zeros(len(words), dtype=bool)
        leaf = (np.where(known, self.leaf[at], FREQUENT + end) if len(self.hashes) else FREQUENT + end).astype(np.int16)
        share = np.where(known, self.share[at] if len(self.hashes) else 0.0, -np.where(np.isfinite(self.totals[end]), self.totals[end], 0.0))
        return leaf, share, wh, known


class Encoder(dict):
    """Numbers of words, handed out as they come up, for one worker; leaf, share, hash and known by number."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.new = vocabulary, []
        self.table = vocabulary.look_up([])

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int, float, np.ndarray]]:
        """Of each text: leaves (16-bit numbers), their count, summed log shares, and the hashes of its occurrences of
        unknown words."""
        if len(self) > REMEMBERED:
            self.clear()
            self.table = self.vocabulary.look_up([])
        numbers = [np.array(list(map(self.__getitem__, (t or "").split())), dtype=np.int64) for t in texts]
        if self.new:
            self.table = tuple(np.concatenate(x) for x in zip(self.table, self.vocabulary.look_up(self.new), strict=True))
            self.new = []
        leaf, share, wh, known = self.table
        size = np.array([len(x) for x in numbers])
        at = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(size)
        sums = np.concatenate(([0.0], np.cumsum(share[at])))
        leaves, rare = leaf[at], np.flatnonzero(~known[at])
        hashes, cut = wh[at[rare]], np.searchsorted(rare, np.concatenate(([0], ends)))
        return [(leaves[e - n : e].tobytes(), int(n), float(sums[e] - sums[e - n]), hashes[cut[i] : cut[i + 1]]) for i, (e, n) in enumerate(zip(ends.tolist(), size.tolist(), strict=True))]


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols and, of every row, row (its number), leaves (16-bit numbers), n_tokens, within (summed log shares but for
    the logarithms of the counts of unknown words) and rare (hashes of the occurrences of unknown words)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept: list[Encoder] = []

    @F.pandas_udf("leaves binary, n_tokens long, within double, rare array<long>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(Encoder(sent.value))
        rows, lot, size = [], [], 0
        for t in texts:
            lot.append(t)
            size += len(t or "")
            if size > 4_000_000:
                rows += kept[0].encode(lot)
                lot, size = [], 0
        rows += kept[0].encode(lot)
        return pd.DataFrame(rows, columns=["leaves", "n_tokens", "within", "rare"])

    return docs.select(*id_cols, F.monotonically_increasing_id().alias("row"), encode(F.col(text_col)).alias("e")).select(*id_cols, "row", "e.*")


def leaves_of(blobs: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.int16) for b in blobs]


def windows(tokens: list[np.ndarray], pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of all texts in turn, and the REACH leaves before and after each; of those in ``pick``, if given."""
    pad = np.full(REACH, EDGE, dtype=np.int16)
    line = np.concatenate([pad, *[x for t in tokens for x in (t, pad)]])
    at = np.flatnonzero(line != EDGE)
    at = at if pick is None else at[pick]
    return line[at], np.stack([line[at + d] for d in [*range(-REACH, 0), *range(1, REACH + 1)]], axis=1)


@dataclass
class Network:
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(leaf_counts: np.ndarray | None = None) -> Network:
        """Random embeddings, and the occurrences of leaves and clusters as offsets."""
        rng = np.random.default_rng(0)
        w = {k: np.zeros(s, dtype=np.float32) for k, s in SHAPES.items()}
        w["embed"][:] = rng.normal(size=SHAPES["embed"]) * 0.1
        w["w1"][:] = rng.normal(size=SHAPES["w1"]) * 1.5 / math.sqrt(len(w["w1"]))
        if leaf_counts is not None:
            by = leaf_counts.reshape(CLUSTERS, LEAVES) + 0.01
            w["b2"][:] = np.log(by.sum(axis=1) / by.sum())
            w["b3"][:] = np.log(by / by.sum(axis=1, keepdims=True))
        return Network(w)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in SHAPES])

    @staticmethod
    def of(vector: np.ndarray) -> Network:
        w, at = {}, 0
        for k, s in SHAPES.items():
            n = math.prod(s)
            w[k], at = vector[at : at + n].reshape(s).astype(np.float32), at + n
        return Network(w)

    @staticmethod
    def by_cluster(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the targets by cluster, and (cluster, from, to) of each cluster's stretch."""
        cluster = target // LEAVES
        order = np.argsort(cluster, kind="stable")
        cut = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1)).tolist()
        return order, [(k, cut[k], cut[k + 1]) for k in range(CLUSTERS) if cut[k] < cut[k + 1]]

    def log_probs(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log-probability of each target leaf given its context."""
        w = self.weights
        tables = np.einsum("ve,keh->kvh", w["embed"], w["w1"].reshape(2 * REACH, WIDTH, HIDDEN))
        out = np.empty(len(target))
        for at in range(0, len(target), BLOCK):
            t = target[at : at + BLOCK]
            order, stretches = self.by_cluster(t)
            t, c = t[order], context[at : at + BLOCK][order]
            h = tables[0][c[:, 0]]
            for k in range(1, 2 * REACH):
                h += tables[k][c[:, k]]
            h += w["b1"]
            np.tanh(h, out=h)
            z = h @ w["w2"]
            z += w["b2"]
            own = z[np.arange(len(t)), t // LEAVES]
            np.exp(z, out=z)
            logs = own - np.log(z.sum(axis=1))
            for k, i, j in stretches:
                z = h[i:j] @ w["w3"][k]
                z += w["b3"][k]
                own = z[np.arange(j - i), t[i:j] % LEAVES]
                np.exp(z, out=z)
                logs[i:j] += own - np.log(z.sum(axis=1))
            out[at + order] = logs
        return out


class Learner:
    """Adagrad on a network, by one partition; seen: windows it has trained on."""

    def __init__(self, network: Network, squares: Network, rate: float = RATE, seen: int = 0):
        self.network, self.squares, self.rate, self.seen = network, squares, rate, seen

    def train(self, target: np.ndarray, context: np.ndarray) -> None:
        """One pass of gradient steps, in order."""
        at = 0
        while at < len(target):
            n = min(BATCH, max(FIRST, self.seen // 16))
            self.step(target[at : at + n], context[at : at + n])
            at += n
            self.seen += n

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        w = self.network.weights
        order, stretches = Network.by_cluster(target)
        t, c = target[order], context[order]
        n, lane = len(t), np.arange(len(t))
        e = w["embed"][c].reshape(n, -1)
        h = e @ w["w1"]
        h += w["b1"]
        np.tanh(h, out=h)
        p = softmax(h @ w["w2"], w["b2"])
        p[lane, t // LEAVES] -= 1
        dh = p @ w["w2"].T
        grad = {"w2": h.T @ p, "b2": p.sum(axis=0), "w3": np.zeros_like(w["w3"]), "b3": np.zeros_like(w["b3"])}
        for k, i, j in stretches:
            q = softmax(h[i:j] @ w["w3"][k], w["b3"][k])
            q[lane[: j - i], t[i:j] % LEAVES] -= 1
            dh[i:j] += q @ w["w3"][k].T
            grad["w3"][k], grad["b3"][k] = h[i:j].T @ q, q.sum(axis=0)
        dh *= 1 - h * h
        de = (dh @ w["w1"].T).reshape(-1, WIDTH)
        flat = c.ravel()
        grad |= {"w1": e.T @ dh, "b1": dh.sum(axis=0), "embed": np.stack([np.bincount(flat, de[:, k], CLASSES + 1) for k in range(WIDTH)], axis=1).astype(np.float32)}
        for k, g in grad.items():
            s = self.squares.weights[k]
            s += g * g
            w[k] -= self.rate * g / np.sqrt(s)


def softmax(z: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """In place; steps are bounded by the rate, so scores stay far below where exp overflows."""
    z += offsets
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def picked(before: int, n: int, round_: int) -> np.ndarray:
    """Which of n windows a round uses, after ``before`` windows of the same partition."""
    at = (before + np.arange(n)) % CYCLE
    return np.flatnonzero((at >= ROUNDS[round_][0]) & (at < ROUNDS[round_][1]))


def fit(codes: DataFrame, vocabulary: Vocabulary, rate: float = RATE) -> Network:
    """The network trained on all rows of ``codes`` (see :func:`encoded`); only its weights and their summed squares
    reach the driver."""
    network, sc = Network.fresh(vocabulary.leaf_counts), codes.sparkSession.sparkContext
    squares = Network({k: np.full(s, 1e-3, dtype=np.float32) for k, s in SHAPES.items()})
    for round_ in range(len(ROUNDS)):
        start = sc.broadcast((network.vector(), squares.vector()))

        def learn(batches: Iterator[pd.DataFrame], start=start, round_=round_) -> Iterator[pd.DataFrame]:
            own, used, n = None, 0, 0
            for b in batches:
                if len(b):
                    tokens = leaves_of(b.leaves)
                    if own is None:
                        own = Learner(Network.of(start.value[0]), Network.of(start.value[1]), rate)
                    size = sum(map(len, tokens))
                    pick = picked(n, size, round_)
                    n += size
                    own.seen = max(own.seen, n * ROUNDS[round_][0] // CYCLE)
                    own.train(*windows(tokens, pick))
                    used += len(pick)
            if used:
                both = np.concatenate([own.network.vector(), own.squares.vector()]) * np.float32(used)
                rows = np.pad(both, (0, -len(both) % ROW)).reshape(-1, ROW)
                yield pd.DataFrame({"i": np.arange(len(rows)), "v": list(rows), "n": float(used)})

        sums = codes.select("leaves").mapInPandas(learn, "i int, v array<float>, n double").groupBy("i").agg(F.array(*[F.sum(F.get("v", F.lit(k))) / F.sum("n") for k in range(ROW)]).alias("v"))
        got = sorted(sums.collect(), key=lambda r: r.i)
        if got:
            both = np.concatenate([r.v for r in got])
            size = len(network.vector())
            network, squares = Network.of(both[:size]), Network.of(both[size : 2 * size])
    return network


def network_scores(codes: DataFrame, network: Network) -> DataFrame:
    """codes plus leaf_prob: each row's summed log-probability of its leaves."""
    sent = codes.sparkSession.sparkContext.broadcast(network.vector())
    kept: list[Network] = []

    @F.pandas_udf("double")
    def score(blobs: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Network.of(sent.value))
        tokens = leaves_of(blobs)
        sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        out, at = np.zeros(len(tokens)), 0
        while at < len(tokens):  # whole texts, about BLOCK tokens at once
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 4 * BLOCK, side="right")) + at)
            ends = np.concatenate(([0.0], np.cumsum(kept[0].log_probs(*windows(tokens[at:to])))))
            n = np.cumsum(sizes[at:to])
            out[at:to] = ends[n] - ends[n - sizes[at:to]]
            at = to
        return pd.Series(out)

    return codes.withColumn("leaf_prob", score(F.col("leaves")))


def scored(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, n_tokens (long) and log_prob (double) of every whole text under a network trained on all of docs.

    A text without words (null, empty, blank) has 0 tokens and a log_prob of 0. Repeated rows keep their rows, score
    alike, and count as often as they occur. Other columns are not read. Weights depend on how the rows are dealt over
    partitions, so scores of two runs agree if the input is partitioned alike, up to the order of sums.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*id_cols, text_col)
    counts = checkpoint(word_counts(docs, text_col))
    vocabulary = Vocabulary.of(counts)
    codes = checkpoint(encoded(docs, vocabulary, id_cols, text_col))
    network = fit(codes, vocabulary)
    parts = checkpoint(network_scores(codes, network).select(*id_cols, "row", "n_tokens", (F.col("leaf_prob") + F.col("within")).alias("log_prob")))
    logs = counts.filter(F.col("n") < vocabulary.least).select("wh", F.log("n").alias("log_n"))
    rare = codes.select("row", F.explode("rare").alias("wh")).join(logs.hint("shuffle_hash"), "wh")
    added = rare.groupBy("row").agg(F.sum("log_n").alias("added"))
    out = parts.join(added, "row", "left")
    return out.select(*id_cols, "n_tokens", (F.col("log_prob") + F.coalesce("added", F.lit(0.0))).alias("log_prob"))


def op9(docs: DataFrame) -> DataFrame:
    """Score of all documents under a network trained on all of them: doc_id, n_tokens, log_prob and mean_log_prob (null
    without words); nulls, empty texts, repeats and further columns as in :func:`scored`."""
    mean = F.col("log_prob") / F.nullif(F.col("n_tokens"), F.lit(0))
    return scored(docs, ["doc_id"]).select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))
