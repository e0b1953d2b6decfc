"""The tree of one row against that of many and against the library; long words in proportionate time."""

import random
import time

from tokenizers import Tokenizer

from tidemark.llm import bpe, registry


def test_one_row_equals_many_rows_and_the_library(monkeypatch):
    path = registry.tokenizer_path("word_bpe_49k.json")
    library, r = Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(r.choice("aeinrstéß漢 '") for _ in range(r.choice([1, 2, 5, 40, 300, 2000]))) for _ in range(60)]
    for few in (0, 1000):
        monkeypatch.setattr(bpe, "FEW_ROWS", few)
        ours = bpe.PairMerger(path)
        assert [[int(x) for x in ids.split()] for _, ids, _ in ours.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words():
    path = registry.tokenizer_path("word_bpe_49k.json")
    ours, r = bpe.PairMerger(path), random.Random(6)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    began = time.time()
    n, ids, _ = next(ours.encode([word]))
    assert time.time() - began < 20 and n == len(ids.split())
    assert [int(x) for x in ids.split()] == Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids
    ours.forget()
    assert word not in ours.memo
