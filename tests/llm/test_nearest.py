"""Nearest neighbours: repeated queries, vectors at the limits of doubles, many dimensions."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    out = []
    for i, x in queries:
        score = []
        for j, y in rows:
            if j != i and len(y) == len(x):
                s = 0.0
                for a, b in zip(x, y):
                    s += a * b
                score.append((np.inf if s != s else -s, j))
        out += [(i, r, j) for r, (_, j) in enumerate(sorted(score)[:k], 1)]
    return sorted(out)


def check(spark, rows, k=5, **blocks):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q_v", F.lit(1)).withColumn("near", F.lit(2))
    queries = [r for r in dict((f"{i} {x}", (i, x)) for i, x in rows).values() if r[0] % 20 == 0]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k, **blocks).collect())
    assert got == brute(rows, queries, k)


def test_repeated_queries(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist()) for i in range(100)]
    check(spark, rows + [rows[20], rows[20], rows[40], rows[33], (60, r.normal(size=6).tolist())], candidate_block=16, query_block=3)


def test_limits_of_doubles(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=4) * s).tolist()) for i, s in enumerate(np.repeat([1.0, 1e200, 1e-200, 1e-310, 1e150, 1e300], 20))]
    check(spark, rows, candidate_block=50)
    check(spark, rows)


def test_many_dimensions(spark):
    r = np.random.default_rng(3)
    base = r.choice([-1.0, 1.0], size=3000)
    rows = [(i, np.where(r.random(3000) < i / 400, 1.0, base).tolist()) for i in range(60)]
    check(spark, rows, candidate_block=25)
