"""Token counts by byte-pair merging over a heap and a linked list.

A pretokenised piece starts as its UTF-8 bytes in a doubly linked list. A heap holds the adjacent pairs that have a
merge rule; the lowest rank (leftmost on a tie) is popped again and again, its pair is merged and the two new
neighbouring pairs are pushed. The count of a piece is its number of bytes minus its merges; no token is emitted.
"""

from __future__ import annotations

import heapq
import json

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import small_batches

# The pretokenisation pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces of one lot whose counts a worker remembers.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, with its byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_rules(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Merge ranks by pair of byte strings (one character a byte), and the special strings that are one token each."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = byte_letters()
    raw = lambda s: "".join(chr(letters[c]) for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
    return {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}, [t["content"] for t in file["added_tokens"]]


def piece_count(piece: str, ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left of one piece (one character a byte) when no rule applies any more."""
    n = len(piece)
    rank_of, pop, push = ranks.get, heapq.heappop, heapq.heappush
    part: list[str | None] = list(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, pair) for i, pair in enumerate(zip(piece, piece[1:], strict=False)) if (rank := rank_of(pair)) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, (a, b) = pop(heap)
        j = after[i]
        if part[i] != a or j >= n or part[j] != b:
            continue  # one of the two has been merged since
        part[i], part[j] = whole, _ = a + b, None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := rank_of(pair := (whole, part[k]))) is not None:
                push(heap, (rank, i, pair))
        if (h := before[i]) >= 0 and (rank := rank_of(pair := (part[h], whole))) is not None:
            push(heap, (rank, h, pair))
    return left


class Counter(dict):
    """Token counts of pieces, filled as they are asked for; the latest two lots of REMEMBERED pieces are kept."""

    def __init__(self, rules: tuple[dict[tuple[str, str], int], list[str]]):
        super().__init__()
        self.older: dict[str, int] = {}
        self.ranks, special = rules
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece) or piece_count(piece.encode().decode("latin-1"), self.ranks)
        self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of its whole text.

    Null and empty texts count 0 and 0. Repeated rows and null ids keep their rows. The driver reads the vocabulary
    file and broadcasts its merge rules, whose size is fixed by the file; texts and counts never leave the executors.
    """
    small_batches(docs.sparkSession)
    rules = docs.sparkSession.sparkContext.broadcast(load_rules(vocabulary))
    kept: list[Counter] = []

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Counter(rules.value))
        return pd.Series([kept[0].count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op7(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 512)
