"""Operator 12: hard negatives by an inverted multi-index.

Vectors become whole numbers (floor(256 * x)), so that scores, their inner products, are exact. Each half of the dimensions has
a codebook (k-means on a sample of at most ``SAMPLE`` rows); a row's two codes name its cell. Rows are dealt to blocks by the hash of vec_id; each
block holds an index of all its rows by cell. For an anchor, the score of a half is at most that of the code's centre plus
the anchor's length times the code's radius in the block; a heap visits cells by the sum of both halves' bounds, highest
first (multi-sequence). Two passes:

1. The ``positives`` best other rows of the anchor's label: a block stops once that many are held and the next cell's bound is below the last.
2. For every positive of score p, the ``negatives`` best rows of other labels with lowest * p <= 100 * score <= highest * p: a cell
   whose scores all lie above every open window is passed over; a block stops once each window is certified, that is, full and ahead of
   the next cell's bound, or the bound is below the window.

Each pass joins blocks of anchors with blocks of rows and merges the blocks' short lists. Every block is searched whole but for what its
bounds rule out, so the result is exact whatever the codebooks are.

Edge cases: rows whose vec_id, label or vector is null, whose vector is empty or holds a null or non-finite component take no part; only vectors of
equal length meet; an anchor meets rows of other vec_ids only; repeated rows count as candidates one each, and repeated anchors as one
(anchors of one vec_id with different vectors or labels have lists each); a negative score p has the window that the inequality gives (none, or 0 for
p = 0); scores are exact, but those beyond 37 digits count as that
limit, and those beyond 64 bits are shown as the nearest 64-bit number; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: Rows that the codebooks are fitted on at most, rounds of fitting; rows a cell has on average, where a half has between two and 32 codes.
SAMPLE, ROUNDS, CELL = 8192, 8, 64
#: Bytes of vectors (as doubles) in a block; rows a block has at least where there are fewer blocks than cores; rows whose scores are computed at once.
BLOCK_BYTES, LEAST_BLOCK, BATCH = 16 << 20, 8192, 2048
#: Components beyond which no bounds are taken.
LARGE = 1e100
#: Scores are kept up to this size between the passes.
MOST = 10**37


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) in doubles, which hold it exactly, or in Python's numbers where that leaves their range."""
    with np.errstate(over="ignore"):
        x = np.floor(256 * vectors)
    return x if np.isfinite(x).all() else np.array([[256 * int(v) if abs(v) > 1e300 else int(np.floor(256 * v)) for v in row] for row in vectors], dtype=object)


def scores(rows: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products; ``small``: doubles hold them and all partial sums."""
    if small:
        return (rows @ anchor).astype(np.int64)
    own = [int(v) for v in anchor]
    return np.array([sum(int(v) * w for v, w in zip(row, own)) for row in rows], dtype=object)


def codebook(sample: np.ndarray, codes: int = 16, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a half, by k-means from evenly spaced rows of the sample in the order of their first principal direction."""
    if not sample.shape[1]:
        return np.zeros((1, 0))
    x = np.unique(sample, axis=0)
    if len(x) <= codes:
        return x
    direction = x - x.mean(0)
    side = direction.T @ direction @ np.ones(x.shape[1])
    centres = x[np.argsort(direction @ side, kind="stable")[np.linspace(0, len(x) - 1, codes).astype(int)]]
    for _ in range(rounds):
        own = nearest_code(sample, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_code(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


class CellIndex:
    """The rows of one block by the cells of two half codebooks, with the radius of each code in each half."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        half = vectors.shape[1] // 2
        self.halves = (slice(0, half), slice(half, None))
        # beyond, squares leave the range of doubles, and all cells are visited
        self.top = float(np.abs(vectors).max()) if vectors.dtype == np.float64 else np.inf
        self.bounded = self.top < LARGE
        near = vectors if self.bounded else np.zeros(vectors.shape)
        codes, self.centres, self.radii = [], [], []
        for part, book in zip(self.halves, books):
            own = nearest_code(near[:, part], book) if len(book) else np.zeros(len(near), int)
            book = book if len(book) else np.zeros((1, near[:, part].shape[1]))
            away = np.linalg.norm(near[:, part] - book[own], axis=1)
            radius = np.zeros(len(book))
            np.maximum.at(radius, own, away)
            codes.append(own)
            self.centres.append(book)
            self.radii.append(radius)
        width = len(self.centres[1])
        cell = codes[0] * width + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.vectors = ids[order], labels[order], np.ascontiguousarray(vectors[order])
        self.first = np.searchsorted(cell[order], np.arange(len(self.centres[0]) * width + 1)).tolist()
        self.used = [np.unique(c) for c in codes]

    def small(self, anchor: np.ndarray) -> bool:
        return anchor.dtype == np.float64 and self.top * float(np.abs(anchor).max()) * len(anchor) < 2.0**53

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, float, slice]]:
        """Cells with rows, by the sum of both halves' upper bounds from the highest on: bound, lower bound, rows."""
        if not self.bounded or anchor.dtype != np.float64 or np.abs(anchor).max() > LARGE:
            for a, b in zip(self.first[:-1], self.first[1:]):
                if b > a:
                    yield np.inf, -np.inf, slice(a, b)
            return
        sides = []
        for part, centres, radii, used in zip(self.halves, self.centres, self.radii, self.used):
            own = anchor[part]
            size = np.linalg.norm(own)
            middle, reach = centres[used] @ own, size * radii[used]
            reach = reach + 1e-9 * (size * np.linalg.norm(centres[used], axis=1) + reach) + 1e-6  # for rounding
            order = np.argsort(-(middle + reach), kind="stable")
            sides.append((used[order].tolist(), (middle + reach)[order].tolist(), (middle - reach)[order].tolist()))
        (one, high1, low1), (two, high2, low2) = sides
        width = len(self.centres[1])
        # the pair (i, 0) is offered when (i - 1, 0) has been taken, (i, j + 1) when (i, j) has
        heap = [(-(high1[0] + high2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-(high1[i] + high2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(high1[i + 1] + high2[0]), i + 1, 0))
            at = one[i] * width + two[j]
            a, b = self.first[at], self.first[at + 1]
            if b > a:
                yield -bound, low1[i] + low2[j], slice(a, b)


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, then id."""
    if len(score) > 4 * k and score.dtype != object:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return kept[np.lexsort((ids[kept], -score[kept]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], dtype=int)


def search(index: CellIndex, anchor: np.ndarray, wanted, windows: list[tuple[int, int]], k: int, skip: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most score) the first k rows of the index whose label is ``wanted`` and whose id isn't ``skip``."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    small = index.small(anchor)
    stretch, n = [], 0
    # a window is certified below its least score and, once full, below its last; cells above all open windows hold nothing
    ends = [least for least, _ in windows]
    stop, top = min(ends), max(most for _, most in windows)

    def take() -> None:
        nonlocal stretch, n, stop, top
        rows = np.concatenate([np.arange(s.start, s.stop) for s in stretch])
        rows = rows[wanted(index.labels[rows]) & (index.ids[rows] != skip)]
        stretch, n = [], 0
        if not len(rows):
            return
        score, ids = scores(index.vectors[rows], anchor, small), index.ids[rows]
        for w, (least, most) in enumerate(windows):
            fits = (score >= max(least, ends[w])) & (score <= most)
            if fits.any():
                s, i = np.concatenate([held[w][0], score[fits]]), np.concatenate([held[w][1], ids[fits]])
                best = first_of(s, i, k)
                held[w] = s[best], i[best]
                if len(best) == k:
                    ends[w] = held[w][0][-1]
        stop = min(ends)

    for bound, low, rows in index.visit(anchor):
        if bound < stop:
            break
        if low > top:
            continue
        stretch.append(rows)
        n += rows.stop - rows.start
        if n >= BATCH:
            take()
            top = max((most for (_, most), end in zip(windows, ends) if bound >= end), default=top)
    if stretch:
        take()
    return held


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, lowest: int = 30, highest: int = 90, block: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both tables have vec_id, label, embedding."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", F.col("label").cast("long").alias("label"), v.alias("v"), F.size(v).alias("dim"))

    c = saved(usable(rows).withColumn("key", F.xxhash64("vec_id", "label", "v")), "rows")
    a = saved(usable(anchors).dropDuplicates(["vec_id", "label", "v"]).withColumn("key", F.xxhash64("vec_id", "label", "v")), "anchors")
    shape = c.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    room = block or max(1, BLOCK_BYTES // (8 * shape["dim"]))
    spread = 1 if block else min(2 * rows.sparkSession.sparkContext.defaultParallelism, shape["n"] // LEAST_BLOCK)
    columns, lines = max(1, spread, -(-shape["n"] // room)), max(1, -(-a.count() // room))

    # a sample by hash, so that reruns agree; dimensions that it lacks have a single cell
    room_for = min(SAMPLE, max(1, (64 << 20) // (8 * shape["dim"])))
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < min(1 << 30, (2 * room_for << 30) // max(1, shape["n"]) + 1)
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, own in c.filter(share).orderBy("key").limit(room_for).select("dim", "v").toPandas().groupby("dim")["v"]:
        x = np.stack(own.to_numpy())
        if np.abs(x).max() < LARGE / 256:
            x = whole(x)
            codes = min(32, max(2, round((shape["n"] / columns / CELL) ** 0.5)))
            books[int(dim)] = codebook(x[:, :dim // 2], codes), codebook(x[:, dim // 2:], codes)

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    right = dealt(c, "c", columns, "r", lines).groupBy("dim", "r", "c")

    def indexed(b: pd.DataFrame) -> CellIndex:
        x = whole(np.stack(b["v"].to_numpy()))
        one = np.zeros((1, x.shape[1] // 2)), np.zeros((1, x.shape[1] - x.shape[1] // 2))
        return CellIndex(b["vec_id"].to_numpy(), b["label"].to_numpy(), x, books.get(x.shape[1], one))

    def searched(left: DataFrame, run, schema: str) -> DataFrame:
        left = dealt(left, "r", lines, "c", columns)
        left = left.select(*(F.col(x).alias(f"a_{x}") for x in left.columns))
        return left.groupBy("a_dim", "a_r", "a_c").cogroup(right).applyInPandas(run, schema)

    def number(s) -> Decimal:
        return Decimal(min(max(int(s), -MOST), MOST))

    def find_positives(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            index = indexed(b)
            for vec_id, label, key, x in zip(q["a_vec_id"], q["a_label"], q["a_key"], whole(np.stack(q["a_v"].to_numpy()))):
                (score, ids), = search(index, x, lambda own: own == label, [(-np.inf, np.inf)], positives, vec_id)
                out += [(key, int(i), number(s)) for s, i in zip(score, ids)]
        return pd.DataFrame(out, columns=["key", "positive_id", "p"])

    def find_negatives(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            index = indexed(b)
            for vec_id, label, key, found, x in zip(q["a_vec_id"], q["a_label"], q["a_key"], q["a_found"], whole(np.stack(q["a_v"].to_numpy()))):
                windows = [(-(-lowest * int(f["p"]) // 100), highest * int(f["p"]) // 100) for f in found]
                places = [i for i, (least, most) in enumerate(windows) if least <= most]
                if places:
                    for i, (score, ids) in zip(places, search(index, x, lambda own: own != label, [windows[i] for i in places], negatives, vec_id)):
                        out += [(key, vec_id, int(found[i]["place"]), int(found[i]["positive_id"]), number(found[i]["p"]), int(j), number(s)) for s, j in zip(score, ids)]
        return pd.DataFrame(out, columns=["key", "anchor_id", "place", "positive_id", "p", "negative_id", "s"])

    by = Window.partitionBy("key").orderBy(F.desc("p"), "positive_id")
    p = searched(a, find_positives, "key long, positive_id long, p decimal(38,0)").withColumn("place", F.row_number().over(by))
    p = saved(p.filter(F.col("place") <= positives), "positives")
    told = p.groupBy("key").agg(F.collect_list(F.struct("place", "positive_id", "p")).alias("found"))  # as many as ``positives``
    n = searched(a.join(told, "key"), find_negatives, "key long, anchor_id long, place int, positive_id long, p decimal(38,0), negative_id long, s decimal(38,0)")
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("s"), "negative_id"))).filter(F.col("rank") <= negatives)

    def as_long(c: str) -> Column:
        return F.greatest(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.least(F.lit((1 << 63) - 1).cast("decimal(38,0)"), F.col(c))).cast("long")

    return n.select("anchor_id", "positive_id", "rank", "negative_id", as_long("p").alias("positive_score"), as_long("s").alias("negative_score"))
