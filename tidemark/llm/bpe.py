"""Operator 9: byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Each word of a batch is a row of a matrix. Its segment tree holds, for each adjacent pair of symbols, the rank of the
merge and the position, so that the root is the leftmost pair of lowest rank. A merge changes three leaves at most and
their paths to the root; it goes on until no root names a mergeable pair. All words of a batch take their steps
together, so the tree's levels are array operations; a few long words alone have a tree each in plain lists.

Edge cases: null and empty texts give no ids, an empty decoded text and zero tokens; the strings of added tokens inside
a text become those tokens; a text of one word of any length takes a tree of that length; null ids, repeated rows and
further columns of the input pass unchanged.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_text, bounded_batches, leaving_memory

#: Words that one worker keeps with their ids; beyond it and between tasks only those it met first, among which the
#: frequent ones are. It changes no result.
MEMO_WORDS, MEMO_KEPT = 300_000, 100_000
#: Characters of a word beyond which it isn't kept, and rows of symbols from which on array steps pay.
MEMO_LONG, FEW_ROWS = 200, 24

#: The vocabulary's fixed pattern and its white space, as the tokenizer file gives them.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: str.split() takes these for white space, the tokenizer does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairMerger:
    """Vocabulary and merges of a tokenizer file, with the segment-tree encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max((self.vocab | self.added).values())
        self.number, self.token = [str(i) for i in range(size)], [""] * size
        for t, i in (self.vocab | self.added).items():
            self.token[i] = t
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        key, rank = left << 20 | right, np.arange(len(pairs))
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], rank[order]
        self.pair = dict(zip(key.tolist(), rank.tolist()))
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.byte = np.array([self.vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([self.vocab.get(c + self.suffix, -1) for c in letters], np.int64)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.memo: dict[str, tuple[int, str, str]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b, or -1."""
        key = np.where((a >= 0) & (b >= 0), a << 20 | b, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge each row of symbols (padded with -1; the width is a power of two). Merged-away places become -1."""
        n, width = ids.shape
        none = np.int64(2**62)
        place = np.arange(width)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), none)
        rank = self.ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((n, 0), np.int64)
        tree[:, width:2 * width - 1] = np.where(rank >= 0, rank * width + place[:-1], none)
        level = width
        while level > 1:  # parents of a level from its leaves
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < none) if width > 1 else np.empty(0, np.int64)
        while len(rows):
            best = tree[rows, 1]
            a = best % width
            b = after[rows, a]
            ids[rows, a] = self.made[best // width]
            ids[rows, b] = -1
            c, p = after[rows, b], before[rows, a]
            after[rows, a] = c
            inner = c < width
            before[rows[inner], c[inner]] = a[inner]
            tree[rows, width + b] = none
            nxt = np.where(inner, ids[rows, np.minimum(c, width - 1)], -1)
            r = self.ranks(ids[rows, a], nxt)
            tree[rows, width + a] = np.where(r >= 0, r * width + a, none)
            q = np.maximum(p, 0)
            r = self.ranks(np.where(p >= 0, ids[rows, q], -1), ids[rows, a])
            tree[rows, width + q] = np.where(p >= 0, np.where(r >= 0, r * width + q, none), tree[rows, width + q])
            for leaf in (a, b, q):  # point updates: each path up to the root
                node = (width + leaf) >> 1
                while node[0] >= 1:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < none]
        return ids

    def merge_row(self, ids: list[int]) -> list[int]:
        """The same for one row of symbols: what is left of it."""
        n, none, pairs = len(ids), 1 << 62, self.pair
        width = 1 << max(0, n - 1).bit_length()
        ids = [*ids, *[-1] * (width - n)]
        after, before = list(range(1, width + 1)), list(range(-1, width - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = width + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    break
                tree[k] = value

        while width > 1 and tree[1] < none:
            rank, a = divmod(tree[1], width)
            b = after[a]
            ids[a], ids[b] = int(self.made[rank]), -1
            c, p = after[b], before[a]
            after[a] = c
            put(b, none)
            right = pairs.get(ids[a] << 20 | ids[c]) if c < n else None
            if c < n:
                before[c] = a
            put(a, none if right is None else right * width + a)
            if p >= 0:
                left = pairs.get(ids[p] << 20 | ids[a])
                put(p, none if left is None else left * width + p)
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        """Pieces that the pattern has cut, each one BPE word: its number of tokens, ids and tokens, joined."""
        out: list = [None] * len(pieces)
        raw = [p.encode() for p in pieces]
        length = np.array([len(r) for r in raw], np.int64)
        size = 2 ** np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
        number, token = self.number, self.token
        for width in np.unique(size):
            group = np.flatnonzero(size == width)
            for part in np.array_split(group, max(1, len(group) * int(width) // 2_000_000)):
                n = length[part]
                ids = np.full((len(part), int(width)), -1, np.int64)
                flat = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                ids[np.arange(int(width)) < n[:, None]] = self.byte[flat]
                ids[np.arange(len(part)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
                if len(part) < FEW_ROWS and width > 1 and (ids >= 0).sum() == n.sum():
                    merged = [self.merge_row(row[:k]) for row, k in zip(ids.tolist(), n.tolist())]
                    ids = np.full_like(ids, -1)
                    for row, own in zip(ids, merged):
                        row[:len(own)] = own
                else:
                    ids = self.merge_rows(ids)
                kept = ids >= 0
                flat = ids[kept].tolist()
                said, shown = [number[i] for i in flat], [token[i] for i in flat]
                start = 0
                for i, end in zip(part.tolist(), np.cumsum(kept.sum(1)).tolist()):
                    out[i] = (end - start, " ".join(said[start:end]), " ".join(shown[start:end]))
                    start = end
        return out

    def words(self, text: str) -> list[str]:
        """White-space words; an added token inside the text stands as a word of its own."""
        if self.split_added and "<|" in text:
            parts = self.split_added.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.added else self.words(p))]
        if SEPARATORS.search(text):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def forget(self) -> None:
        """Keep the words met first, but no long ones."""
        self.memo = dict(islice(((w, x) for w, x in self.memo.items() if len(w) <= MEMO_LONG), MEMO_KEPT))

    def learn(self, words: set[str]) -> None:
        """Put the ids and tokens of new words into the memo."""
        cut: list[tuple[str, list[str]]] = []
        pieces: dict[str, int] = {}
        single: dict[str, int] = {}
        for w in words:
            low = w if w.isascii() else unicodedata.normalize("NFC", w)
            low = "".join([c.lower() for c in low]) if "Σ" in low else low.lower()
            if low.isalpha():
                single[w] = pieces.setdefault(low, len(pieces))
                continue
            own = WORD.findall(low)
            cut.append((w, own))
            for p in own:
                pieces.setdefault(p, len(pieces))
        coded = self.encode_pieces(list(pieces))
        self.memo.update((w, coded[i]) for w, i in single.items())
        for w, own in cut:
            got = [coded[pieces[p]] for p in own]
            self.memo[w] = got[0] if len(got) == 1 else (sum(g[0] for g in got), " ".join([g[1] for g in got]), " ".join([g[2] for g in got]))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, the ids and the decoded tokens, each joined by a space."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        split = [self.words(t or "") for t in texts]
        new: set[str] = set()
        for w in split:
            new.update(w)
        new.difference_update(self.memo)
        for t in self.added:
            self.memo[t] = (1, str(self.added[t]), t)
        new.difference_update(self.added)
        self.learn(new)
        get = self.memo.__getitem__
        for w in split:
            n, ids, decoded = zip(*map(get, w)) if w else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(decoded)


_loaded: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One instance a worker process."""
    if path not in _loaded:
        _loaded[path] = PairMerger(path)
    return _loaded[path]


def slices(texts: list, most: int = 500_000) -> Iterator[slice]:
    """Slices of a batch that hold about ``most`` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, tokenizer: str, digests_only: bool = False, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless ``digests_only``, ids and (if ``decoded``) the decoded text themselves."""
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if not digests_only:
        schema += ", ids array<int>" + (", decoded string" if decoded else "")
    names = [c.split()[0] for c in schema.split(", ")][1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = merger(tokenizer)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts):
                rows = []
                for n, ids, shown in bpe.encode(texts[part]):
                    row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
                    more = () if digests_only else (np.fromiter(map(int, ids.split()), np.int32), shown)  # a number takes four bytes there
                    rows.append((*row, *more)[:len(names)])
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "doc_id", batch["doc_id"].iloc[part].array)
                yield out
        bpe.forget()

    coded = bounded_batches(docs).select(as_text("doc_id"), "text").mapInPandas(leaving_memory(run), schema)
    return coded.withColumn("doc_id", F.col("doc_id").cast("long"))
