"""Clusters of periods against plain k-means, planted clusters, means of vectors."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import clusters as K

DAY = dt.date(2024, 1, 1)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(x, centres, rounds):
    x = unit(x)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.array([unit(x[own == i].mean(0)[None])[0] if (own == i).any() else c for i, c in enumerate(centres)])
    near = x @ centres.T
    return near.argmax(1), near.max(1)


def planted(seed, periods=3, noise=0.1):
    """Periods with other directions each, three large clusters and one of three members."""
    r, rows, truth = np.random.default_rng(seed), [], {}
    for p in range(periods):
        centres = np.linalg.qr(r.normal(size=(12, 12)))[0][:4]
        for i in range(123):
            c = i % 3 if i < 120 else 3
            v = (centres[c] + noise * r.normal(size=12)) * r.uniform(.1, 9)
            rows.append((DAY + dt.timedelta(days=7 * p), 1000 * p + i, v.tolist()))
            truth[1000 * p + i] = (p, c)
    return rows, truth


def test_planted_clusters_of_each_period(spark):
    rows, truth = planted(1)
    df = spark.createDataFrame(rows, "period date, id long, embedding array<double>").repartition(5)
    got = {r["id"]: r["topic"] for r in K.cluster_periods(df, k=4).collect()}
    assert len(got) == len(rows)
    named = {}
    for i, (p, c) in truth.items():
        named.setdefault((p, c), set()).add(got[i])
    assert all(len(t) == 1 for t in named.values())
    assert all(named[p, 3] == {-1} and len({min(named[p, c]) for c in range(3)} - {-1}) == 3 for p in range(3))


def test_equals_plain_k_means(spark):
    rows, _ = planted(2, 2, 0.6)
    df = spark.createDataFrame(rows, "period date, id long, embedding array<double>")
    got = {r["id"]: (r["topic"], r["closeness"]) for r in K.cluster_periods(df, k=3, rounds=6, least_size=1, least_closeness=-2).collect()}
    order = [(r["period"], r["id"]) for r in df.orderBy("period", F.xxhash64("id", "embedding"), "id").collect()]
    for p in {r[0] for r in rows}:
        own = {i: v for q, i, v in rows if q == p}
        ids = [i for q, i in order if q == p]
        x = np.array([own[i] for i in ids])
        topic, closeness = plain(x, K.spread_out(unit(x), 3), 6)
        assert [got[i][0] for i in ids] == topic.tolist() and [got[i][1] for i in ids] == pytest.approx(closeness.tolist())


def test_odd_vectors_and_periods(spark):
    rows = [(None, i, [1.0, i / 50]) for i in range(6)] + [(DAY, 10, None), (DAY, 11, [0.0, 0.0]), (DAY, 12, [None, 1.0]), (DAY, 13, [float("nan"), 1.0]), (DAY, 14, []), (DAY, 15, [1.0, 1.0])]
    got = {r["id"]: r["topic"] for r in K.cluster_periods(spark.createDataFrame(rows, "period date, id long, embedding array<double>"), k=1).collect()}
    assert got == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(10, 16), -1)}
    assert K.cluster_periods(spark.createDataFrame([], "period date, id long, embedding array<double>")).collect() == []


def test_means_of_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(int(k), None if k == 3 else "x", [None if r.random() < .1 else float(x) for x in r.normal(size=r.integers(1, 6))]) for k in r.integers(0, 5, 900)] + [(9, "y", None), (9, "y", [])]
    df = spark.createDataFrame(rows, "a long, b string, v array<double>").repartition(6)
    wanted = {}
    for a, b, v in rows:
        for i, x in enumerate(v or []):
            wanted.setdefault((a, b, i), []).append(x)
    got = V.mean_vector(df, ["a", "b"], "v", "m").collect()
    flat = {(x["a"], x["b"], i): m for x in got for i, m in enumerate(x["m"])}
    means = {k: [x for x in v if x is not None] for k, v in wanted.items()}
    assert flat.keys() == means.keys() and all(flat[k] == pytest.approx(np.mean(v)) for k, v in means.items())
    assert {x["a"]: x["n"] for x in got} == {k: sum(1 for a, _, v in rows if a == k and v) for k in range(5)}
