"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its own characters and words and those of the lines before and after it. A two-state
chain (good, bad) is trained on labelled documents, each line bearing its document's label; forward-backward gives
every line's marginal, and a document's score is the mean of the good marginals weighted by line length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import small_batches

#: Bound of the labelled documents that a model is fitted on: those of the smallest hash of the id.
SAMPLE = 4000
#: In training only, a longer document is cut into chains of so many lines.
CHAIN = 64
#: Characters of text whose features are made at once.
BLOCK = 4_000_000
#: Lines whose features are made at once when scoring, and features of a line itself.
LINES = 50_000
OWN = 16


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 space, 4 sentence marks, 5 other ASCII marks, 6 beyond ASCII."""
    out = np.full(256, 5, dtype=np.uint8)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    out[128:] = 6
    return out


CLASSES = byte_classes()


def line_features(lines: list[str]) -> np.ndarray:
    """One row of OWN features a line; an empty line's are zero but for the constant."""
    raw = [x.encode() for x in lines]
    sizes = np.array([len(x) for x in raw])
    out = np.zeros((len(lines), OWN))
    out[:, 0] = 1
    held = np.flatnonzero(sizes)
    if len(held):
        kinds = CLASSES[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        starts = (np.cumsum(sizes) - sizes)[held]
        for k in range(7):
            out[held, 1 + k] = np.add.reduceat((kinds == k).astype(np.int32), starts) / sizes[held]
    out[:, 8] = np.log1p(sizes) / 8
    for i, x in enumerate(lines):
        words = x.split()
        if words:
            n, seen = len(words), Counter(words)
            out[i, 9] = len(seen) / n
            out[i, 10] = max(seen.values()) / n
            out[i, 11] = min(len(x) / n / 10, 3)
            out[i, 12] = np.log1p(n) / 8
            out[i, 13] = x.rstrip()[-1:] in ".!?"
            out[i, 14] = sum(map(str.isupper, words)) / n
            out[i, 15] = sum(map(eq, words, words[1:])) / n
    return out


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Features of each line next to those of the lines before and after; zeros beyond a document's ends."""
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after])


def chains(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts in turn, the weight (length) of each, and the number of lines of each text."""
    split = [(t or "").split("\n") for t in texts]
    counts = np.array([len(x) for x in split])
    lines = [x for xs in split for x in xs]
    ends = np.cumsum(counts)
    return with_neighbours(line_features(lines), ends - counts, ends - 1), np.array([len(x) + 1.0 for x in lines]), counts


def good(both: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


@dataclass
class Chain:
    """Weights of the states' score (features) and of the moves between states (2 x 2; 0 bad, 1 good); scale: slope and
    offset that calibrate a document's log-odds."""

    emit: np.ndarray
    move: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts by falling number of lines, where each begins, and how many have a line t."""
        order = np.argsort(-counts, kind="stable")
        starts = np.cumsum(counts) - counts
        live = len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max(initial=0)), side="right")
        return order, starts[order], live

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Each line's probability of good; expected moves (2 x 2); summed log normaliser."""
        order, starts, live = self.padded(counts)
        a, alpha, beta = self.passes(x @ self.emit, starts, live)
        moves = np.zeros((2, 2))
        last = (starts + counts[order] - 1)[counts[order] > 0]
        z = np.zeros(len(counts))
        z[: len(last)] = np.logaddexp(alpha[last, 0], alpha[last, 1])
        log_z = float(z.sum())
        for t in range(1, len(live)):
            at = starts[: live[t]] + t
            pair = alpha[at - 1][:, :, None] + self.move + (a[at] + beta[at])[:, None, :] - z[: live[t], None, None]
            moves += np.exp(pair).sum(axis=0)
        return good(alpha + beta), moves, log_z

    def line_marginals(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each line's probability of good from the lines' scores."""
        _, starts, live = self.padded(counts)
        _, alpha, beta = self.passes(score, starts, live)
        return good(alpha + beta)

    def passes(self, score: np.ndarray, starts: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log scores by state, and the forward and backward sums."""
        a = np.zeros((len(score), 2))
        a[:, 1] = score
        alpha, beta = a.copy(), np.zeros_like(a)
        for t in range(1, len(live)):
            at = starts[: live[t]] + t
            alpha[at] += np.logaddexp(alpha[at - 1, 0:1] + self.move[0], alpha[at - 1, 1:2] + self.move[1])
        for t in range(len(live) - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            ahead = a[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(ahead[:, 0:1] + self.move[:, 0], ahead[:, 1:2] + self.move[:, 1])
        return a, alpha, beta

    def line_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of every line of the texts in turn, its weight, and the number of lines of each text. Features are
        made for LINES lines at a time, so that a text of very many lines takes little memory."""
        split = [(t or "").split("\n") for t in texts]
        counts = np.array([len(x) for x in split])
        lines = [x for xs in split for x in xs]
        parts = self.emit.reshape(3, OWN).T
        made = np.concatenate([line_features(lines[at : at + LINES]) @ parts for at in range(0, len(lines), LINES)])
        ends = np.cumsum(counts)
        before, after = np.roll(made[:, 1], 1), np.roll(made[:, 2], -1)
        before[ends - counts], after[ends - 1] = 0, 0
        return made[:, 0] + before + after, np.array([len(x) + 1.0 for x in lines]), counts

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the good marginals of each text's lines, calibrated."""
        slope, offset = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * self.log_odds(texts) + offset, -700, 700)))

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        score, weight, counts = self.line_scores(texts)
        p = self.line_marginals(score, counts)
        starts = np.cumsum(counts) - counts
        mean = np.clip(np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))


def calibrate(z: np.ndarray, good: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels on log-odds z, by Newton steps from (1, 0) with a ridge there."""
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - good) / len(z) + ridge * (w - [1, 0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(z) + ridge * np.eye(2), grad)
    return float(max(w[0], 0.05)), float(w[1])


def train(texts: list[str | None], marks: list[int], rounds: int = 120, decay: float = 1e-3) -> Chain:
    """Fit by full-batch Adam on the chains' mean log-likelihood with an L2 penalty. No texts: scores are 0.5."""
    model = Chain(np.zeros(3 * OWN), np.zeros((2, 2)))
    if not texts:
        return model
    x, _, counts = chains(texts)
    label = np.repeat(np.array(marks, dtype=float), counts)
    cut = np.concatenate([np.diff(np.append(np.arange(0, n, CHAIN), n)) for n in counts])
    side = np.repeat(np.array(marks), [-(-n // CHAIN) for n in counts])
    stays = np.zeros((2, 2))
    np.add.at(stays, (side, side), cut - 1)
    emit_seen = x.T @ label
    theta, m, v = np.zeros(3 * OWN + 4), np.zeros(3 * OWN + 4), np.zeros(3 * OWN + 4)
    for step in range(1, rounds + 1):
        model = Chain(theta[:-4], theta[-4:].reshape(2, 2))
        p, moves, _ = model.marginals(x, cut)
        g = np.concatenate([x.T @ p - emit_seen, (moves - stays).ravel()]) / len(x) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.15 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Chain(theta[:-4], theta[-4:].reshape(2, 2))
    return Chain(model.emit, model.move, calibrate(model.log_odds(texts), np.array(marks, dtype=float)))


def fold(id_col: Column) -> Column:
    """crc32 of the id's text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Train on at most ``sample`` labelled documents outside the held-out third (:func:`fold` is 1), those with the
    smallest hash of doc_id; rows with a null label or id are no examples. Only their texts go to the driver."""
    known = labels.filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 1).select("doc_id", "quality")
    ids = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality")
    rows = sorted(rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample).collect(), key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text for r in rows], [int(r.quality > 0) for r in rows])


def with_score(docs: DataFrame, model: Chain, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs plus the quality score (0 to 1) of every whole text; a null or empty text is one empty line."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        made, block, size = [], [], 0
        for t in [*texts, None]:
            block.append(t)
            size += len(t or "")
            if size > BLOCK:
                made.append(model.scores(block))
                block, size = [], 0
        made.append(model.scores(block))
        return pd.Series(np.concatenate(made)[: len(texts)])

    return docs.withColumn(out, score(F.col(text_col)))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of all documents, learnt from the labels outside the held-out third. A null or empty text is one empty
    line and has a score; rows of equal text score alike, and every repeated row has its own; a null id counts as the
    empty text in the fold; an empty table gives no rows. Ties of the training sample go to the smaller id."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
