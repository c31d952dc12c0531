import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    rng = random.Random(3)
    texts = ["", " ", "a", "  \n\n x", "it's they'll we'd", "é漢字🙂‍🙂", "<|endoftext|>a <|endoftext|><|endoftext|>", "<|endoftext", "\x1c\x1d a b  c​", "aaaaaaa" * 3000, " " * 5000 + "z"]
    alphabet = "abcthe  \n\t'sre.,!?0123éüß漢🙂 ́\x1f\x85"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(400)]
    counter = bpe.Counter(bpe.load_rules(PATH))
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(None) == 0


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    want = {(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows}
    assert {tuple(r) for r in bpe.op7(docs).collect()} == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, bpe.op7(df).collect()), key=str) == [(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False)]
    assert bpe.op7(df.limit(0)).count() == 0
