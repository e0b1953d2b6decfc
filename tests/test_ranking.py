"""Sentences of long documents, ranked by many tasks, against the ranking in one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, summaries as M


def sparse(r, n, dim=12):
    x = np.zeros((n, dim))
    for i in range(n):
        group = i % 3
        x[i, group * 4 + r.choice(4, r.integers(0, 4), replace=False)] = r.integers(1, 4)
    return x


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def frame(spark, docs):
    return spark.createDataFrame([(k, i, row.tolist()) for k, x in docs.items() for i, row in enumerate(x)], "doc long, pos int, v array<double>").repartition(5)


def test_both_ways_equal_the_ranking_in_one_task(spark):
    r = np.random.default_rng(1)
    docs = {k: unit(sparse(r, n)) for k, n in ((1, 90), (2, 40), (3, 1))}
    wanted = {(k, i): w for k, x in docs.items() for i, w in enumerate(M.lexrank(np.maximum(x @ x.T, 0)))}
    df = frame(spark, docs)
    for got in (ranking.factored_weights(df, "doc"), ranking.block_weights(df, "doc", [12], [1.0], 16)):
        found = {(x["doc"], x["pos"]): x["weight"] for x in got.collect()}
        assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(w, abs=1e-12) for k, w in wanted.items())


def test_negative_numbers_and_two_parts(spark):
    r = np.random.default_rng(2)
    a, b = unit(r.normal(size=(70, 5))), unit(sparse(r, 70, 12))
    wanted = M.lexrank(0.3 * np.maximum(a @ a.T, 0) + 0.7 * np.maximum(b @ b.T, 0))
    got = ranking.block_weights(frame(spark, {7: np.hstack([a, b])}), "doc", [5, 12], [0.3, 0.7], 20)
    assert [x["weight"] for x in got.orderBy("pos").collect()] == pytest.approx(wanted.tolist())


@pytest.mark.parametrize("signed", [False, True])
def test_summaries_of_long_documents(spark, monkeypatch, signed):
    r = np.random.default_rng(3)
    rows = [(k, i, f"s{i}", (r.normal(size=6) if signed and k == 1 else np.abs(r.normal(size=6)) * (r.random(6) < .5)).tolist()) for k, n in ((1, 60), (2, 12), (3, 45)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc long, pos int, sentence string, embedding array<double>")
    whole = sorted(map(tuple, M.lexrank_summary(df, "doc").collect()))
    monkeypatch.setattr(M, "LONG", 20)
    assert sorted(map(tuple, M.lexrank_summary(df, "doc").collect())) == whole and len(whole) == 8


def test_fifty_thousand_sentences(spark):
    """One document of 50 000 sentences; no task holds its graph, which would have 20 GB."""
    n = 50_000
    v = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(5)).cast("double") * (F.pmod(F.xxhash64("id", i, F.lit(1)), F.lit(4)) == 0).cast("double"))
    df = spark.range(n).select(F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("s"), "id").alias("sentence"), v.alias("embedding"))
    got = [r["pos"] for r in M.lexrank_summary(df, "doc").orderBy("pos").collect()]
    x = unit(np.array([r["embedding"] for r in df.orderBy("pos").collect()]))
    assert got == sorted(np.argsort(-np.round(M.factored_lexrank(x), 12), kind="stable")[:3].tolist())
