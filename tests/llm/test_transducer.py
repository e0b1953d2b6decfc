"""Token counts with chunks cut anywhere, against the library; the scan against steps one by one."""

import random
import time

import numpy as np
import pytest
import sentencepiece

from tidemark.llm import registry, token_counts


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer_path("piece_bpe_32k.model")


def texts(n, seed):
    r = random.Random(seed)
    letters = "abcdeeettaainnoorsé ß漢字▁ \n\t.-'’1239ÀΩж😀"
    for _ in range(n):
        kind = r.random()
        yield "".join(r.choice(letters if kind < 0.5 else "aeinrst" if kind < 0.8 else "theinga ") for _ in range(r.choice([0, 1, 3, 20, 90, 400, 1500])))


@pytest.mark.parametrize("chunk,warm", [(512, 32), (7, 0), (3, 1), (16, 2)])
def test_any_cut_gives_the_librarys_counts(path, monkeypatch, chunk, warm):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "WARM", warm)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.CountingTransducer(path)
    many = list(texts(150, chunk))
    assert ours.counts(many).tolist() == [len(library.encode(t)) for t in many]


def test_long_text_without_spaces(path):
    r = random.Random(3)
    long = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    took = {}
    for n in (50_000, 200_000):  # the time grows in proportion
        ours = token_counts.CountingTransducer(path)
        ours.counts(["warm up"])
        began = time.process_time()
        got = ours.counts([long[:n]])[0]
        took[n] = time.process_time() - began
    assert took[200_000] < 8 * took[50_000] and not any(len(w) > token_counts.MEMO_LONG for w in ours.memo)
    assert got == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(long))


def test_tables_that_start_anew_within_a_text(path, monkeypatch):
    for name, n in (("PIECE", 50), ("MOST_STATES", 40), ("CHUNK", 16), ("WARM", 2), ("ROWS", 4096), ("COLUMNS", 8)):
        monkeypatch.setattr(token_counts, name, n)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.CountingTransducer(path)
    many = list(texts(80, 11))
    assert ours.counts(many).tolist() == [len(library.encode(t)) for t in many]


def test_memory_of_all_letters(path):
    """All characters of the vocabulary and 700 000 of them at random: the tables stay small."""
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.CountingTransducer(path)
    letters = sorted({c for p in ours.score for c in p} - {token_counts.SPACE_MARK})
    r = random.Random(5)
    text = "".join(letters) + "".join(r.choices(letters, k=700_000))
    assert ours.counts([text])[0] == len(library.encode(text))
    table = (ours.after, ours.adds, ours.others.keys, ours.others.to, ours.others.add)
    assert sum(x.nbytes for x in table) < 100 << 20 and len(ours.states) < token_counts.MOST_STATES + token_counts.PIECE


def test_chunks_are_read_in_few_steps(path, monkeypatch):
    """As many chunks side by side as keep the array steps few: 400 at most for 100 000 characters."""
    library, ours, steps = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.CountingTransducer(path), []
    look = ours.transitions
    monkeypatch.setattr(ours, "transitions", lambda s, c: steps.append(len(s)) or look(s, c))
    text = "some words and others " * 4 + "".join(random.Random(3).choices("theinga", k=100_000))
    ours.counts([text])
    steps.clear()
    ours.memo.clear()
    assert ours.counts([text])[0] == len(library.encode(text)) and len(steps) <= 400


def test_scan_equals_steps():
    maps = np.random.default_rng(1).integers(0, 4, (37, 4))
    at = np.arange(4)
    for k, out in enumerate(token_counts.scanned(maps)):
        at = maps[k][at]
        assert (out == at).all()
