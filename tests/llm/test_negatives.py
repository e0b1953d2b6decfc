"""Hard negatives against a full search, and the index against its bounds."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<double>, v string, key int, dim int"


def plain(rows, anchors=None):
    def usable(r):
        return None not in r[:3] and len(r[2]) and all(x is not None and math.isfinite(x) for x in r[2])

    rows = [(i, k, [math.floor(256 * Fraction(x)) for x in v]) for i, k, v in rows if usable((i, k, v))]
    out = []
    for i, k, q in {(i, k, tuple(v)) for i, k, v in rows if i % 100 == 0}:
        met = [(-sum(a * b for a, b in zip(q, v)), j, m) for j, m, v in rows if j != i and len(v) == len(q)]
        for p, j in sorted((s, j) for s, j, m in met if m == k)[:5]:
            fits = sorted((s, n) for s, n, m in met if m != k and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(fits, 1)]
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    return sorted((*o[:4], clip(o[4]), clip(o[5])) for o in out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in N.hard_negatives(df, df.filter("vec_id % 100 = 0"), **more).collect())


def made(seed, n=400, dim=8):
    r = np.random.default_rng(seed)
    return [(int(i), int(r.integers(4)), v.tolist()) for i, v in enumerate(r.normal(size=(n, dim)) + r.normal(size=dim) * r.choice([0, 2], (n, 1)))]


@pytest.mark.parametrize("seed, block", [(1, None), (2, 60)])
def test_equals_a_full_search(spark, seed, block):
    rows = made(seed)
    rows += [rows[100], rows[100], rows[7], (200, 3, made(9, 1)[0][2]), (300, 1, [1.0] * 5), (17, 2, [2.0] * 5), (18, 1, [2.0] * 5), (19, 3, [1.5] * 5)]
    rows += [(None, 1, [1.0] * 8), (1000, None, [1.0] * 8), (1100, 1, None), (1200, 1, []), (1300, 1, [1.0, None] * 4), (1400, 2, [float("nan")] * 8), (1500, 2, [float("inf")] * 8)]
    wanted = plain(rows)
    assert wanted and found(spark, rows, block=block) == wanted


def test_ties_zeros_one_dimension_and_common_vectors(spark):
    rows = [(i, i % 3, [0.5, 0.25]) for i in range(300)] + [(i, i % 3, [0.4, 0.2]) for i in range(300, 420)] + [(i, i % 2, [0.0, 0.0]) for i in range(420, 505)] + [(600 + i, i % 2, [i / 9]) for i in range(60)] + [(700, 0, [-1.0])]
    assert found(spark, rows, block=100) == plain(rows)
    assert found(spark, [], block=None) == [] and found(spark, [(100, 1, [1.0])]) == []


def test_numbers_beyond_doubles(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 2, (r.random(3) * s).tolist()) for i, s in enumerate(np.repeat([1.0, 3e9, 1e16], 80))]
    rows = [(100 * (i % 20 == 0) * i or i, k, v) for i, k, v in rows]
    assert found(spark, rows) == plain(rows)
    huge = np.array([[1.7e308, -3.0], [1e306, 0.3]])
    assert [[int(x) for x in row] for row in N.whole(huge)] == [[math.floor(256 * Fraction(x)) for x in row] for row in huge.tolist()]


def test_cells_come_by_bound_and_bounds_hold():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(size=(3000, 10)))
    index = N.CellIndex(np.arange(3000), np.zeros(3000, int), x, (N.codebook(x[:500, :5]), N.codebook(x[:500, 5:])))
    for q in x[:20]:
        seen, last = 0, np.inf
        for high, low, rows in index.visit(q):
            own = index.vectors[rows] @ q
            assert high <= last and low <= own.min() and own.max() <= high
            seen, last = seen + len(own), high
        assert seen == 3000


def test_search_stops_before_the_end():
    r = np.random.default_rng(4)
    centres = r.normal(size=(8, 16)) * 6
    x = np.floor(256 * (centres[r.integers(8, size=4000)] + r.normal(size=(4000, 16)) * .1))
    index = N.CellIndex(np.arange(4000), np.zeros(4000, int), x, (N.codebook(x[:600, :8]), N.codebook(x[:600, 8:])))
    looked, inner = 0, N.scores

    def counted(rows, anchor, small):
        nonlocal looked
        looked += len(rows)
        return inner(rows, anchor, small)

    N.scores, batch, N.BATCH = counted, N.BATCH, 256
    try:
        for q in x[:20]:
            (score, ids), = N.search(index, q, lambda own: own == 0, [(-np.inf, np.inf)], 5, -1)
            assert score.tolist() == sorted((x @ q).astype(int).tolist(), reverse=True)[:5]
    finally:
        N.scores, N.BATCH = inner, batch
    assert looked < 20 * 4000 / 2
