"""Where a phrase stands in a text, word for word or nearly so.

A window of as many tokens as the phrase has words is scored by the sets of both sides' words: 100 if one set holds the other (and they
share a word), else the best of the similarities between the shared words, the shared words with the phrase's rest, and with the window's
rest. The similarity of two strings is twice their longest common subsequence over both lengths, as a whole number of percent. The first
window of the highest score counts, if that is over a minimum.

Windows are judged in bulk: sums over runs of letter counts bound the common subsequence from above, and only windows that the bound
lets reach the minimum are compared, by the bit-parallel recurrence on 64 letters at once, for all of them side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes that letters are counted in (by code point), letters of a pattern that the recurrence takes at once.
LETTERS, WORD_BITS = 64, 64


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, of strings of any length."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


def lcs_all(pairs: list[tuple[str, str]]) -> np.ndarray:
    """lcs of each pair; those whose shorter side has at most WORD_BITS letters go side by side."""
    out = np.zeros(len(pairs), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    short = [i for i, (a, _) in enumerate(pairs) if len(a) <= WORD_BITS]
    for i in set(range(len(pairs))) - set(short):
        out[i] = lcs(*pairs[i])
    if not short:
        return out

    def codes(texts: list[str], width: int) -> np.ndarray:
        return np.array([np.pad(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), (0, width - len(t)), constant_values=-1) for t in texts]).reshape(len(texts), width)

    short.sort(key=lambda i: len(pairs[i][1]))
    for at in range(0, len(short), 4096):
        own = short[at:at + 4096]
        pattern, text = codes([pairs[i][0] for i in own], WORD_BITS), codes([pairs[i][1] for i in own], max(len(pairs[i][1]) for i in own))
        text = np.where(text < 0, -2, text)  # filler meets nothing
        row = np.full(len(own), ~np.uint64(0))
        with np.errstate(over="ignore"):
            for j in range(text.shape[1]):
                bits = np.packbits(pattern == text[:, j:j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
                met = row & bits
                row = (row + met) | (row - met)
        out[own] = np.bitwise_count(~row)
    return out


def best_windows(phrases: list[str], texts: list[list[str]], least: float) -> list[tuple[str, int]]:
    """(window, score) of each phrase in its tokens; ("", 0) where no window scores over ``least``."""
    where = {t: i for i, t in enumerate(dict.fromkeys(t for tokens in texts for t in tokens))}
    size = np.array([len(t) for t in where], np.int64)
    every = np.frombuffer("".join(where).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % LETTERS
    letters = np.bincount(np.repeat(np.arange(len(where)) * LETTERS, size) + every, minlength=len(where) * LETTERS).reshape(-1, LETTERS)
    asked: list[tuple[int, int, str, str, int, int]] = []  # row, window, both rests, lengths with what is shared
    scores: list[dict[int, int]] = [{} for _ in phrases]
    for row, (phrase, tokens) in enumerate(zip(phrases, texts)):
        words, n = set(phrase.split()), len(phrase.split())
        if not n or len(tokens) < n:
            continue
        ids = np.array([where[t] for t in tokens])
        starts = len(tokens) - n + 1
        # letters that both sides have, and blanks; repeated words of a window only lower what it can reach
        mine = np.zeros(LETTERS, np.int64)
        for w in words:
            np.add.at(mine, np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, 1)
        own_letters = np.flatnonzero(mine)  # no other letters are common
        total = np.concatenate([np.zeros((1, len(own_letters)), np.int64), letters[np.ix_(ids, own_letters)].cumsum(0)])
        common = np.minimum(total[n:] - total[:starts], mine[own_letters]).sum(1) + len(words) - 1
        length = np.concatenate([[0], size[ids].cumsum()])
        shared = np.isin(ids, [where[w] for w in words if w in where])
        known = np.concatenate([[0], shared.cumsum()])
        held = np.concatenate([[0], (size[ids] * shared).cumsum()])
        n_known, joined = known[n:] - known[:starts], held[n:] - held[:starts]
        joined = joined + np.maximum(n_known - 1, 0)
        new = ids[:, None] if n == 1 else np.lib.stride_tricks.sliding_window_view(ids, n)
        repeated = (np.diff(np.sort(new, axis=1), axis=1) == 0).any(1) if n > 1 else np.zeros(starts, bool)
        own, wide = sum(map(len, words)) + len(words) - 1, length[n:] - length[:starts] + n - 1
        # twice what is common over both lengths: of the whole sides, and of the shared words with either side
        reach = np.maximum(200 * common / (own + wide), 200 * joined / np.minimum(joined + own, joined + wide))
        for at in np.flatnonzero(repeated | (reach > least - 1)):
            window = set(tokens[at:at + n])
            both = words & window
            a, b = " ".join(sorted(words - both)), " ".join(sorted(window - both))
            if both and (not a or not b):
                scores[row][int(at)] = 100
                break  # nothing scores more, and what comes before has been asked
            core = len(" ".join(sorted(both)))
            gap = 1 if both else 0
            asked.append((row, int(at), a, b, core + gap + len(a), core + gap + len(b)))
            if both:  # shared words against shared words with either rest
                scores[row][int(at)] = max(round(200 * core / (2 * core + gap + len(x))) for x in (a, b))
    found = lcs_all([(a, b) for _, _, a, b, _, _ in asked])
    for (row, at, a, _, x, y), common in zip(asked, found.tolist()):
        score = round(200 * (common + x - len(a)) / max(1, x + y))
        scores[row][at] = max(score, scores[row].get(at, 0))
    out = []
    for phrase, tokens, own in zip(phrases, texts, scores):
        at = min(own, key=lambda i: (-own[i], i), default=None)
        good = at is not None and own[at] > least
        out.append((" ".join(tokens[at:at + len(phrase.split())]), own[at]) if good else ("", 0))
    return out


def phrase_match(rows: DataFrame, least: float = 80.0) -> DataFrame:
    """key, phrase, window, score of ``rows`` (key, phrase, tokens); an empty window and 0 where nothing scores over ``least``.

    A null phrase or null tokens match nothing.
    """
    @F.pandas_udf("struct<window:string,score:double>")
    def best(phrases: pd.Series, tokens: pd.Series) -> pd.DataFrame:
        found = best_windows([p or "" for p in phrases], [[t for t in x if t is not None] if x is not None else [] for x in tokens], least)
        return pd.DataFrame([(w, float(s)) for w, s in found], columns=["window", "score"])

    return rows.withColumn("b", best("phrase", "tokens")).select("key", "phrase", "b.window", "b.score")
