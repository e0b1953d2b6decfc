"""Operator 6: token counts by a compiled finite-state transducer.

A sequence of pieces is what byte-pair encoding gives exactly if each two neighbours are what it gives for their
concatenation. So the encoding of a prefix is known from those of shorter prefixes, and a deterministic transducer
follows it: a state holds the places where a piece that is still open may have begun, the piece that ends there and the
count of tokens there against now. Reading a character leads to a state and changes the count by an annotated number.
States and transitions are compiled when first met. Those of early states and letters stand in a dense block of fixed size, the others in a
hash table, so that memory grows with the transitions met; every ``PIECE`` characters a table with too many states starts anew
from the state that is reached.

Texts are laid end to end and cut into chunks of ``CHUNK`` characters, anywhere. The map of a chunk says for entry states to which
state it leads. Which entry states are possible is told by reading the ``WARM`` characters before the chunk, and by the exits of the
chunk before; all chunks are read side by side as array steps, until every exit has its entry in the next map. The maps
then compose through a parallel prefix scan, which gives each chunk's true entry state and with it the counts on its transitions.

No piece holds a white-space mark behind another character, so a mark behind another character resets the state. Texts are split
into segments there, and a worker reads each distinct segment once.

Edge cases: null and empty texts have no tokens and no bytes; characters outside the vocabulary count their UTF-8 bytes;
a text of any length, also without any space, is many chunks; null ids, repeated rows and further columns pass unchanged; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import slices
from tidemark.llm.common import as_text, bounded_batches

SPACE_MARK = "▁"
#: Characters of a chunk, and those before it that are read to guess its entry state.
CHUNK, WARM = 128, 32
SEGMENT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
#: Segments whose counts a worker keeps; beyond, it starts anew. It changes no result.
MEMO_SEGMENTS = 1_000_000
#: Characters of a segment beyond which it isn't kept.
MEMO_LONG = 200
#: States beyond which the table starts anew at the next piece; characters of a piece. Neither changes a result.
MOST_STATES, PIECE = 150_000, 1 << 18
#: States and letters of the dense block of transitions.
ROWS, COLUMNS = 1 << 16, 128


class Cells:
    """Transitions by state and letter in a hash table with open addresses."""

    def __init__(self, bits: int = 12):
        self.bits, self.held = bits, 0
        self.keys, self.to, self.add = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or else the free place where its search ends."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            there = self.keys[at[rest]]
            rest = rest[(there != keys[rest]) & (there != -1)]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
        return at

    def put(self, key: int, to: int, add: int) -> None:
        if self.held * 2 >= len(self.keys):
            self.widen()
        at, last = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits, len(self.keys) - 1
        while (there := self.keys[at]) != -1 and there != key:
            at = at + 1 & last
        self.held += there == -1
        self.keys[at], self.to[at], self.add[at] = key, to, add

    def widen(self) -> None:
        used = self.keys != -1
        keys, to, add, held = self.keys[used], self.to[used], self.add[used], self.held
        self.__init__(self.bits + 1)
        rest = np.arange(len(keys))
        while len(rest):  # of those that end at one place the first takes it
            at = self.places(keys[rest])
            at, first = np.unique(at, return_index=True)
            took = rest[first]
            self.keys[at], self.to[at], self.add[at] = keys[took], to[took], add[took]
            rest = np.setdiff1d(rest, took)
        self.held = held


class CountingTransducer:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.order = {p: i for i, p in enumerate(sorted(self.score, key=lambda p: (len(p) > 1, -self.score[p])))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.extensions: dict[str, list[str]] = {}
        for p in self.score:
            for k in range(1, len(p)):
                self.extensions.setdefault(p[:k], []).append(p)
        self.fits: dict[tuple[str, str], bool] = {}
        self.alive: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, int] = {}
        # Columns 1 to 4: characters in no piece, by their UTF-8 length; the characters of pieces get theirs when met.
        self.column = np.zeros(0x110000, np.int16)
        for low, high, n in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            self.column[low:high] = n
        self.letters = ["", "", "", "", ""]  # private letters stand for those four
        for c in sorted({c for p in self.score for c in p}):
            self.column[ord(c)] = -1
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((("", None, 0),))]
        self.number = {self.states[0]: 0}
        self.fits.clear()
        self.alive.clear()
        self.after = np.full((4096, COLUMNS), -1, np.int32)
        self.adds = np.zeros((4096, COLUMNS), np.int8)
        self.others = Cells()

    def numbered(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.after) < len(self.states) <= ROWS:
                self.after = np.concatenate([self.after, np.full_like(self.after, -1)])
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)])
        return self.number[state]

    def transitions(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each leads (-1: not compiled yet) and what it adds."""
        # the last row and column of the dense block stay empty, so that whatever lies beyond is missed there
        at = np.minimum(states, len(self.after) - 1).astype(np.int64) * COLUMNS + np.minimum(columns, COLUMNS - 1)
        to, add = self.after.reshape(-1).take(at), self.adds.reshape(-1).take(at)
        missed = np.flatnonzero(to < 0)
        far = missed[(states[missed] >= ROWS - 1) | (columns[missed] >= COLUMNS - 1)]
        if len(far):
            keys = states[far].astype(np.int64) << 16 | columns[far]
            at = self.others.places(keys)
            known = self.others.keys[at] == keys
            to[far[known]], add[far[known]] = self.others.to[at[known]], self.others.add[at[known]]
        return to, add

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one in an encoding of its own; None if its encoding is another."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
                if parts[best] + parts[best + 1] not in self.score:
                    break
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 and piece in self.score else None
        return self.halves[piece]

    def adjacent(self, a: str | None, b: str) -> bool:
        """Whether both stay apart when a text of the two is encoded: undo their merges from the last one back and
        see whether the two symbols at the border would have merged before."""
        if len(b) > 1 and self.split(b) is None:
            return False
        if a is None:
            return True
        key = (a, b)
        if key in self.fits:
            return self.fits[key]
        order, halves, score = self.order, self.split, self.score
        limit, fine = 1 << 40, True
        while True:
            if a + b in score and halves(a + b) == (a, b) and order[a + b] < limit:
                fine = False
                break
            left, right = order.get(a, -1), order.get(b, -1)
            if left > right and len(a) > 1 or len(b) == 1:
                if len(a) == 1:
                    break
                limit, a = left, halves(a)[1]
            else:
                limit, b = right + 1, halves(b)[0]
        self.fits[key] = fine
        return fine

    def open(self, s: str, last: str | None) -> bool:
        """Whether a piece that begins with s may yet follow ``last`` (for many pieces: taken as so)."""
        longer = self.extensions.get(s)
        if not longer or last is None or len(longer) > 40:
            return bool(longer)
        key = (s, last)
        if key not in self.alive:
            self.alive[key] = any(self.adjacent(last, u) for u in longer)
        return self.alive[key]

    def compile(self, state: int, column: int) -> None:
        """One transition: where it leads and what it adds to the count."""
        c = self.letters[column]
        weight = column if column <= 4 else 1
        live = [(s + c, last, n) for s, last, n in self.states[state]]
        last, count = next((s, n + (weight if len(s) == 1 else 1)) for s, before, n in live
                           if (len(s) == 1 or s in self.score) and self.adjacent(before, s))
        new = tuple((s, before, n - count) for s, before, n in live if self.open(s, before)) + (("", last, 0),)
        to = self.numbered(new)
        if state < ROWS - 1 and column < COLUMNS - 1:
            self.after[state, column], self.adds[state, column] = to, count
        else:
            self.others.put(state << 16 | column, to, count)

    def columns(self, points: np.ndarray) -> np.ndarray:
        cols = self.column[points]
        if (cols < 0).any():
            for p in np.unique(points[cols < 0]).tolist():
                self.column[p] = len(self.letters)
                self.letters.append(chr(p))
            cols = self.column[points]
        return cols

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: the chunk sums of its segments, each distinct segment read by the transducer once."""
        if len(self.memo) > MEMO_SEGMENTS:
            self.memo.clear()
        split = [self.segments(t) for t in texts]
        new: set[str] = set()
        for parts in split:
            new.update(w for w in set(parts) if w not in self.memo)  # the memo isn't walked through
        if new:
            told = list(new)
            self.memo.update(zip(told, self.read(told).tolist()))
        get = self.memo.__getitem__
        total = np.array([sum(map(get, parts)) for parts in split], np.int64)
        for w in [w for w in new if len(w) > MEMO_LONG]:
            del self.memo[w]
        return total

    @staticmethod
    def segments(text: str) -> list[str]:
        """The parts that begin at a run of spaces (or the text's start), without the first space of the run."""
        if not text:
            return []
        parts = text.split(" ")
        if SPACE_MARK in text or "" in parts:
            marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
            return [m[1:] for m in SEGMENT.findall(marked)]
        return parts

    def walk(self, cols: np.ndarray, fresh: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, added: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """Read the stretches side by side from their entry states; exit states. What the transitions add goes to ``added``
        from the places ``at`` on."""
        order = np.argsort(-length, kind="stable")
        begin, out, left = start[order], state[order].astype(np.int32), length[order]
        to_place = None if added is None else at[order]
        running = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # stretches longer than t
        for t in range(len(running)):
            k = running[t]
            p = begin[:k] + t
            s, c = np.where(fresh[p], 0, out[:k]), cols[p]
            to, add = self.transitions(s, c)
            missing = to < 0
            if missing.any():
                for a, b in {*zip(s[missing].tolist(), c[missing].tolist())}:
                    self.compile(a, b)
                to, add = self.transitions(s, c)
            if added is not None:
                added[to_place[:k] + t] = add
            out[:k] = to
        exits = np.empty(len(start), np.int32)
        exits[order] = out
        return exits

    def read(self, segments: list[str]) -> np.ndarray:
        """Run the transducer over texts that each begin with a space mark which is not written."""
        joined = SPACE_MARK + SPACE_MARK.join(segments)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0, *(len(s) + 1 for s in segments)])
        cols = self.columns(points)
        mark = points == ord(SPACE_MARK)
        fresh = mark.copy()  # where the state is that of an empty text
        fresh[1:] &= ~mark[:-1]
        fresh[begins[:-1]] = True
        added, state = np.zeros(len(points), np.int8), 0
        for low in range(0, len(points), PIECE):
            if len(self.states) > MOST_STATES:
                reached = self.states[state]
                self.reset()
                state = self.numbered(reached)
            part = slice(low, low + PIECE)
            added[part], state = self.read_piece(cols[part], fresh[part], state)
        return np.add.reduceat(added.astype(np.int32), begins[:-1]).astype(np.int64)

    def read_piece(self, cols: np.ndarray, fresh: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """What each transition adds from the given state on, and the state reached: maps of chunks and their scan."""
        start = np.arange(0, len(cols), CHUNK)
        length = np.minimum(CHUNK, len(cols) - start)
        warm = np.minimum(start, WARM)
        # maps: a column for each entry state; what each adds, column by column
        entry = self.walk(cols, fresh, start - warm, warm, np.zeros(len(start), np.int32))[:, None]
        entry[0, 0] = state
        entry[fresh[start], 0] = 0
        added = [np.zeros(len(cols), np.int8)]
        leads = self.walk(cols, fresh, start, length, entry[:, 0], added[0], start)[:, None]
        while True:
            met = leads[:-1, :, None] == entry[1:, None, :]
            follows = np.where(fresh[start[1:]][:, None], 0, met.argmax(2))  # column of the next map that an exit is the entry of
            lost = ~met.any(2) & ~fresh[start[1:]][:, None] & (leads[:-1] >= 0)
            if not lost.any():
                break
            k, column = np.nonzero(lost)
            k, first = np.unique(k, return_index=True)  # one new entry a chunk and round
            fresh_entry = leads[k, column[first]]
            entry, leads = (np.concatenate([x, np.full((len(start), 1), -1, np.int32)], 1) for x in (entry, leads))
            added.append(np.zeros(len(cols), np.int8))
            entry[k + 1, -1] = fresh_entry
            leads[k + 1, -1] = self.walk(cols, fresh, start[k + 1], length[k + 1], fresh_entry, added[-1], start[k + 1])
        path = np.concatenate([np.zeros(1, np.int64), scanned(follows)[:, 0]])
        if path.any():
            for j in range(1, len(added)):
                for k in np.flatnonzero(path == j).tolist():
                    added[0][start[k]:start[k] + length[k]] = added[j][start[k]:start[k] + length[k]]
        return added[0], int(leads[-1, path[-1]])


def scanned(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of maps between columns (row k leads from the columns of k to those of k + 1), by doubling."""
    out, d = maps.copy(), 1
    while d < len(out):
        out[d:] = np.take_along_axis(out[d:], out[:-d], 1)
        d *= 2
    return out


_loaded: dict[str, CountingTransducer] = {}


def transducer(model: str) -> CountingTransducer:
    if model not in _loaded:
        _loaded[model] = CountingTransducer(model)
    return _loaded[model]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = transducer(model)
        for batch in batches:
            texts = [t or "" for t in batch["text"].tolist()]
            for part in slices(texts):
                n = fst.counts(texts[part])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].array, "n_bytes": [len(t.encode()) for t in texts[part]], "n_tokens": n, "over_limit": n > limit})

    counted = bounded_batches(docs).select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumn("doc_id", F.col("doc_id").cast("long"))
