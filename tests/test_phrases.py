"""Phrase matching against plain dynamic programming, on random texts."""

import random

import pytest

from tidemark.operators import phrases as P


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return round(200 * plain_lcs(a, b) / (len(a) + len(b))) if a or b else 0


def plain(phrase, tokens, least):
    words, n, best = set(phrase.split()), len(phrase.split()), ("", 0)
    for i in range(len(tokens) - n + 1) if n else []:
        window = set(tokens[i:i + n])
        both, a, b = (" ".join(sorted(s)) for s in (words & window, words - window, window - words))
        if both and (not a or not b):
            score = 100
        else:
            full = [(both + " " + x).strip() for x in (a, b)]
            score = max(ratio(*full), *((ratio(both, f) for f in full) if both else [0]))
        if score > best[1]:
            best = " ".join(tokens[i:i + n]), score
    return best if best[1] > least else ("", 0)


def test_lcs_of_all_lengths():
    r = random.Random(1)
    pairs = [("".join(r.choices("abcé\U0001f600", k=r.choice([0, 1, 5, 63, 64, 65, 130]))), "".join(r.choices("abcé\U0001f600", k=r.choice([0, 3, 64, 90])))) for _ in range(150)]
    assert P.lcs_all(pairs).tolist() == [plain_lcs(a, b) for a, b in pairs] == [P.lcs(a, b) for a, b in pairs]


@pytest.mark.parametrize("seed, least", [(1, 80), (2, 80), (3, 55), (4, 95)])
def test_windows_equal_the_definition(seed, least):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé ", k=r.randint(1, 8))).replace(" ", "x") for _ in range(25)]

    def bent(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + r.choice("abz") + w[i:], w[:i] + w[i + 1:] or "q", w])

    phrases, texts = [], []
    for _ in range(250):
        tokens = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 12, 40]))]
        at = r.randrange(max(1, len(tokens)))
        words = tokens[at:at + r.randint(1, 4)] or ["abc"]
        phrases.append(" ".join(bent(w) for w in r.sample(words, len(words))))
        texts.append(tokens)
    got = P.best_windows(phrases, texts, least)
    assert got == [plain(p, t, least) for p, t in zip(phrases, texts)] and 20 < sum(s > 0 for _, s in got)


def test_long_words_and_nulls(spark):
    long = "x" * 90 + "abc"
    rows = [(1, long + " end", ["start", "y" + long, "end"]), (2, None, ["a"]), (3, "a", None), (4, "alpha beta", ["the", "alphas", "betas"]), (5, "", ["a"])]
    got = {r["key"]: (r["window"], r["score"]) for r in P.phrase_match(spark.createDataFrame(rows, "key long, phrase string, tokens array<string>")).collect()}
    assert got == {1: plain(rows[0][1], rows[0][2], 80), 2: ("", 0.0), 3: ("", 0.0), 4: ("alphas betas", 91.0), 5: ("", 0.0)}
