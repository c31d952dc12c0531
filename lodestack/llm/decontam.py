"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A region that matches a benchmark item of m characters with at most e edits keeps m - q + 1 - q e of the item's
q-grams, all within e + 1 neighbouring diagonals (place in the text minus place in the item). Shared q-grams are
counted in bands of 2 (e + 1) diagonals that overlap by half, so some band holds all of them; the bands that reach the
bound are verified by an alignment confined to their diagonals.

Texts and items are compared as their words (letters and digits) in lower case, with one space between.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import checkpoint, small_batches

WORDS = re.compile(r"[^\W_]+")
Q = 8
RATE = 0.1
#: Characters of benchmark text in one block of items; larger benchmarks take one pass over the documents a block.
BLOCK = 1_000_000
#: Characters of document text that are searched at once.
CHUNK = 2_000_000


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall(lowered(text))) if text else ""


def codes(text: str) -> np.ndarray:
    """One byte a character; different characters may share one, which only makes more candidates."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return (points ^ (points >> 8)).astype(np.uint8)


def grams(code: np.ndarray) -> np.ndarray:
    """All Q-grams as 64-bit numbers."""
    n = len(code) - Q + 1
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(code), strides=(1,)).copy() if n > 0 else np.zeros(0, dtype="<u8")


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The fewest edits (at most ``most``) of the whole item against a part of text that begins and ends on diagonals
    low..high, with that part's start and end (ties: smallest end, then start); None if there is none."""
    far = 1 << 20
    width = high - low + 1
    d = np.arange(low, high + 1)
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    start = d.copy()
    lane = np.arange(width)
    for i in range(1, len(item) + 1):
        j = i + d
        inside = (j >= 1) & (j <= len(text))
        same = text[np.clip(j - 1, 0, max(len(text) - 1, 0))] == item[i - 1] if len(text) else np.zeros(width, dtype=bool)
        step = np.where(inside, cost + ~same, far)
        drop = np.append(cost[1:] + 1, far)
        best = np.where(drop < step, drop, step)
        origin = np.where(drop < step, np.append(start[1:], 0), start)
        best = np.where((j >= 0) & (j <= len(text)), best, far)
        run = np.minimum.accumulate((best - lane) * width * 2 + lane)  # an insertion moves one lane up
        value, source = run // (width * 2) + lane, run % (width * 2)
        origin = origin[source]
        cost, start = np.where((j >= 0) & (j <= len(text)), value, far), origin
        if i % 8 == 0 and cost.min() > most:
            return None
    if cost.min(initial=far) > most:
        return None
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(len(item) + d[k])


@dataclass
class Index:
    """A block of benchmark items: ids, normal texts, edit budgets, and the postings of their Q-grams.

    Up to half of the grams that an item must keep are left out of the postings, those most shared between items, and
    its bound is lowered by as many: a region that reaches the lemma's bound still reaches the lowered one.
    """

    ids: list[int]
    texts: list[str]

    def __post_init__(self) -> None:
        size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = np.maximum(np.minimum((size * RATE).astype(np.int64), (size - Q) // Q), 0)
        self.bound = np.maximum(size - Q + 1 - Q * self.budget, 1)
        made = [grams(codes(t)) for t in self.texts]
        every = np.concatenate(made) if made else np.zeros(0, dtype="<u8")
        item = np.repeat(np.arange(len(made)), [len(g) for g in made])
        place = np.concatenate([np.arange(len(g)) for g in made]) if made else item
        _, inverse, shared = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.lexsort((-shared[inverse], item))  # each item's most shared grams first
        nth = np.arange(len(rank)) - (np.cumsum(sizes := np.array([len(g) for g in made], dtype=np.int64)) - sizes)[item[rank]]
        spare = rank[(nth < self.bound[item[rank]] // 2) & (shared[inverse][rank] > 1)]
        self.bound = self.bound - np.bincount(item[spare], minlength=len(made))
        held = np.setdiff1d(np.arange(len(every)), spare)
        every, item, place = every[held], item[held], place[held]
        order = np.argsort(every, kind="stable")
        self.keys, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.bits = max(16, int(len(every) * 32).bit_length())
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.slot(self.keys)] = True
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < Q]

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) for the best region of each item in each text."""
        if not texts:
            return
        code = codes("\n".join(texts))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        gram = grams(code)
        at = np.flatnonzero(self.seen[self.slot(gram)])
        if len(at) and len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, gram[at]), len(self.keys) - 1)
            real = self.keys[near] == gram[at]
            at, near = at[real], near[real]
            doc = np.searchsorted(starts, at, side="right") - 1
            yield from self.regions(texts, starts, at, doc, near)
        for k in self.short:
            for i, t in enumerate(texts):
                if (p := f" {t} ".find(f" {self.texts[k]} ")) >= 0:
                    yield i, k, 0, p, p + len(self.texts[k])

    def regions(self, texts: list[str], starts: np.ndarray, at: np.ndarray, doc: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Bands that reach the bound, verified; texts are taken in turn so that postings never pile up."""
        total = np.cumsum(self.times[near])
        edges = [0]
        while edges[-1] < len(at):  # whole texts, about CHUNK postings at once
            to = int(np.searchsorted(total, (total[edges[-1] - 1] if edges[-1] else 0) + CHUNK, side="right"))
            to = max(to, edges[-1] + 1)
            edges.append(int(np.searchsorted(doc, doc[min(to, len(at)) - 1], side="right")))
        for lo, hi in zip(edges, edges[1:], strict=False):
            times = self.times[near[lo:hi]]
            spread = np.repeat(self.first[near[lo:hi]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            item, place = self.item[spread], self.place[spread]
            d = np.repeat(doc[lo:hi], times)
            n = len(self.texts)
            low = int(d[0])
            pair = (d - low) * n + item
            if (span := (int(d[-1]) - low + 1) * n) <= 8 * CHUNK:
                enough = np.bincount(pair, minlength=span) >= np.tile(self.bound, span // n)
                keep = enough[pair]  # else too few in all bands together
            else:
                some, inverse, held = np.unique(pair, return_inverse=True, return_counts=True)
                keep = (held >= self.bound[some % n])[inverse]
            if not keep.any():
                continue
            pair, item, place = pair[keep], item[keep], place[keep]
            diagonal = np.repeat(at[lo:hi], times)[keep] - starts[d[keep]] - place
            pairs = distinct(pair)
            short = np.searchsorted(pairs, pair)
            band = diagonal // (self.budget[item] + 1)
            band = np.concatenate([band, band - 1])
            least, width, length = int(band.min()), int(np.ptp(band)) + 1, int(place.max()) + 1
            triple = distinct((np.tile(short, 2) * width + (band - least)) * length + np.tile(place, 2)) // length
            first = np.flatnonzero(np.append(True, triple[1:] != triple[:-1]))
            bands, counts = triple[first], np.diff(np.append(first, len(triple)))
            full = counts >= self.bound[pairs[bands // width] % n]
            bands = bands[full]
            found: dict[int, tuple] = {}
            for c in bands.tolist():
                p, b = int(pairs[c // width]) + low * n, c % width + least
                i, t = divmod(p, n)
                if found.get(p, (1,))[0] == 0:
                    continue
                e = int(self.budget[t])
                if (s := texts[i].find(self.texts[t])) >= 0:
                    found[p] = (0, s, s + len(self.texts[t]))
                    continue
                got = align(codes(self.texts[t]), codes(texts[i]), b * (e + 1) - e, (b + 2) * (e + 1) - 1 + e, e)
                if got and (p not in found or got[:2] < found[p][:2]):
                    found[p] = got
            for p, (edits, s, e) in found.items():
                yield p // len(self.texts), p % len(self.texts), edits, s, e


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> Iterator[Index]:
    """The benchmark's non-empty items in blocks of bounded size; it is read on the driver one block at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        if t := normal(r[1]):
            ids.append(r[0])
            texts.append(t)
            size += len(t)
            if size >= block:
                yield Index(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts)


def chunked(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Normal forms in lots of about CHUNK characters, with the place of each lot's first text."""
    at, lot, size = 0, [], 0
    for t in texts:
        lot.append(normal(t))
        size += len(lot[-1])
        if size >= CHUNK:
            yield at, lot
            at, lot, size = at + len(lot), [], 0
    yield at, lot


def spots(text: str, start: int, end: int) -> tuple[int, int]:
    """Where a span of the normal form lies in the text itself."""
    at, own = 0, []
    for m in WORDS.finditer(lowered(text)):
        if at < end and at + len(m[0]) > start:
            own += [m.start() + max(0, start - at), m.start() + min(len(m[0]), end - at)]
        at += len(m[0]) + 1
    return (own[0], own[-1]) if own else (0, 0)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each document and benchmark item that it holds: id, item_id, n_edits and the characters start..end.

    At most RATE edits a character of the item count as a match (items too short for the lemma get a smaller budget).
    Items of Q characters or more also match inside words; shorter ones, which words hold by chance, as whole words
    only. Of several regions the one with the fewest edits, then
    the first, is returned. Null, empty and wordless texts and items match nothing. Repeated rows each give their rows.
    """
    small_batches(docs.sparkSession)
    out = None
    for index in item_blocks(benchmark, text_col="text", block=block):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts, rows = batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist(), []
                for at, lot in chunked(texts):
                    for i, k, edits, s, e in sent.value.search(lot):
                        s, e = spots(texts[at + i], s, e)
                        rows.append((None if pd.isna(ids[at + i]) else int(ids[at + i]), sent.value.ids[k], edits, s, e))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_edits", "start", "end"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInPandas(search, "doc_id long, item_id long, n_edits long, start long, end long")
        out = part if out is None else checkpoint(out).unionByName(part)  # a worker holds one block's index at a time
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_edits long, start long, end long")
    return out.withColumnRenamed("doc_id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without the documents that hold a benchmark item (see :func:`contamination`)."""
    small_batches(docs.sparkSession)
    for n, index in enumerate(item_blocks(benchmark, block=block)):
        docs = checkpoint(docs) if n else docs  # a worker holds one block's index at a time
        docs = docs.filter(~holder(docs.sparkSession.sparkContext.broadcast(index))(F.col(text_col)))
    return docs


def holder(index: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def held(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        for at, lot in chunked(texts.tolist()):
            for i, *_ in index.value.search(lot):
                out[at + i] = True
        return pd.Series(out)

    return held


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All benchmark items found in all documents."""
    return contamination(docs, benchmark)
