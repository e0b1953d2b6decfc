"""Operator 1: nearest neighbours by a block matrix join.

Candidates and queries are dealt to blocks; each pair of a query block and a candidate block is one group. In a group the
vectors are quantised to int8 with a scale each; products of int8 tiles give approximate inner products with a bound on
the quantisation error (from the norms and the residual norms of both vectors). Candidates whose upper bound reaches the
group's 20th best lower bound survive; for them the inner product is computed again on the original vectors in double
precision, component by component. The lists of a query's blocks are merged by heaps.

Every query meets every candidate, so work grows with the product of both numbers. Blocks take as many vectors as
``BLOCK_BYTES`` allow, so that each candidate is copied once for each query block only (and each query once for each candidate block).

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of equal
length are compared; equal vectors are computed once a block and ties go to the smaller vec_id; a query meets every row
but those of its own vec_id; rows without vec_id take no part; repeated rows of one vec_id count as one candidate each; repeated
queries are one query, and queries of one vec_id with different vectors have a list each; with fewer candidates than ``k`` all are
returned; vectors of any length and of any finite size take part, where products leave the range of doubles no candidate is left out early
and sums that are not a number come last; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors (as doubles) in a block, candidates that a block has at least where there are fewer tasks than cores could take.
BLOCK_BYTES, LEAST_BLOCK = 8 << 20, 1024
#: Queries of a tile, and dimensions whose int8 products have exact sums in float32.
TILE, EXACT_RUN = 128, 1000
#: Products between these are far from the limits of doubles.
SMALL, LARGE = 1e-250, 1e250


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the vectors in units of their largest component, that component, norms in its units, norms of what quantising leaves."""
    top = np.abs(x).max(1)
    unit = x / top[:, None]
    code = np.rint(unit * 127)
    return code.astype(np.int8), top, np.linalg.norm(unit, axis=1), np.linalg.norm(unit - code / 127, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of int8 codes, exactly, in runs of dimensions."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_RUN):
        out += a[:, d:d + EXACT_RUN].astype(np.float32) @ b[:, d:d + EXACT_RUN].astype(np.float32).T
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``b`` in double precision, summed from the first component on."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[1]):
            out += a[:, d] * b[d]
    return out


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best candidates of the block that aren't the query itself: vec_ids and scores."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], np.ascontiguousarray(c[order])
    _, first, same = np.unique(c.view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_index=True, return_inverse=True)
    distinct = c[first]
    members = np.split(np.argsort(same, kind="stable"), np.cumsum(np.bincount(same))[:-1])  # smaller vec_id first
    size = np.array([len(m) for m in members])
    qc, qt, qn, qr = quantised(q)
    cc, ct, cn, cr = quantised(distinct)
    relative = ct / ct.max()
    for lo in range(0, len(q), TILE):
        part = slice(lo, lo + TILE)
        # in units of the query's and the block's largest components
        near = products(qc[part], cc) * (relative / 127**2)
        # |q.c - q'.c'| <= |q||c - c'| + |q - q'||c'|, and |c'| <= |c| + |c - c'|
        error = (qn[part][:, None] * cr + qr[part][:, None] * (cn + cr) + 1e-9 * qn[part][:, None] * cn) * (relative * (1 + 1e-6)) + 1e-290
        upper = near + error
        lower = near
        lower -= error
        # the query itself is at most one of the candidates, so k + 1 of them hold k others
        kth = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)] if len(distinct) > k + 1 else np.full(len(near), -np.inf)
        for i in range(len(near)):
            with np.errstate(over="ignore", under="ignore"):
                plain = SMALL < qt[lo + i] * ct.min() and qt[lo + i] * ct.max() * c.shape[1] < LARGE
            kept = np.flatnonzero(upper[i] >= kth[i]) if plain else np.arange(len(distinct))
            exact = inner(distinct[kept], q[lo + i])
            ranked = np.where(np.isnan(exact), -np.inf, exact)
            by = np.argsort(-ranked, kind="stable")
            at, score, n = [], [], 0
            for j in by:  # whole ties, then cut
                if n > k and ranked[j] < last:
                    break
                own = members[kept[j]][:k + 1 + int((c_ids[members[kept[j]][:k + 1]] == q_ids[lo + i]).sum())]
                at.append(c_ids[own])
                score.append(np.full(len(own), exact[j]))
                last = ranked[j]
                n += min(size[kept[j]], k + 1)
            ids, score = np.concatenate(at), np.concatenate(score)
            other = ids != q_ids[lo + i]
            ids, score = ids[other], score[other]
            by = np.lexsort((ids, np.where(np.isnan(score), np.inf, -score)))[:k]
            yield ids[by], score[by]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest vectors; both tables have vec_id and embedding."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        if "float" not in df.schema["embedding"].dataType.simpleString():
            v = v.cast("array<double>")
        sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", v.alias("v"), F.size(v).alias("dim"))

    c, q = usable(vectors), usable(queries).dropDuplicates(["vec_id", "v"])
    shape = c.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    wanted = q.count()
    room = max(1, BLOCK_BYTES // (8 * shape["dim"]))
    parallel = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    spread = min(parallel, shape["n"] // LEAST_BLOCK)
    columns = max(1, spread if candidate_block is None else 1, -(-shape["n"] // (candidate_block or room)))
    rows = max(1, -(-wanted // (query_block or room)))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    # a table may be joined with itself, so that all columns of one side get names (and ids) of their own
    left = dealt(q, "r", rows, "c", columns).select(*(F.col(x).alias(f"q_{x}") for x in ("dim", "r", "c", "vec_id", "v")), F.xxhash64("v").alias("q_key")).groupBy("q_dim", "q_r", "q_c")
    right = dealt(c, "c", columns, "r", rows).groupBy("dim", "r", "c")

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            a = a.iloc[:0]
        out = [] if not len(a) else [*nearest_in_block(a["q_vec_id"].to_numpy(), np.stack(a["q_v"].to_numpy()).astype(float), b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()).astype(float), k)]
        return pd.DataFrame({"query_id": a["q_vec_id"].array, "key": a["q_key"].array, "near": pd.Series([x[0] for x in out], dtype=object), "scores": pd.Series([x[1] for x in out], dtype=object)})

    blocks = left.cogroup(right).applyInPandas(join, "query_id long, key long, near array<long>, scores array<double>")

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        def told(near: np.ndarray, scores: np.ndarray) -> Iterator[tuple[float, int, float]]:
            for v, s in zip(near, scores):
                yield (np.inf if np.isnan(s) else -s), int(v), float(s)

        best = [*islice(heapq.merge(*(told(np.asarray(v, np.int64), np.asarray(s, float)) for v, s in zip(df["near"], df["scores"]))), k)]
        return pd.DataFrame({"query_id": df["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [b[1] for b in best], "score": [b[2] for b in best]}).astype({"vec_id": "int64", "score": "float64"})

    return blocks.groupBy("query_id", "key").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
