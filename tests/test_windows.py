"""Quantiles of sliding windows against numpy, the sketch's error, brackets that miss, window joins."""

import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import signals as S

DAY0 = dt.date(2023, 12, 25)
SCHEMA = "topic long, seq int, ts date, popularity double, docs_count long, paragraphs_count long"


def series(seed, n, days=40, values=None):
    r = random.Random(seed)
    pick = (lambda: r.choice(values)) if values else (lambda: r.lognormvariate(0, 2))
    return [(r.randrange(20), i, DAY0 + dt.timedelta(days=r.randrange(days)), pick(), 1, 1) for i in range(n)]


def wanted(rows, date, window, p):
    own = [r[3] for r in rows if date - dt.timedelta(days=window) <= r[2] <= date and r[3] > 1e-5]
    return (np.percentile(own, 100 * p), len(own)) if own else (0.0, 0)


@pytest.mark.parametrize("rows, k", [(series(1, 3000), 800), (series(2, 3000), 8), (series(3, 500, values=[1.0, 2.0, 2.0, 3.0, 1e-6]), 8), (series(4, 3), 800)])
def test_thresholds_are_exact(spark, rows, k):
    """Also with sketches so coarse that their brackets miss."""
    dates = [DAY0 + dt.timedelta(days=d) for d in range(-3, 60, 2)]
    got = S.thresholds(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(d,) for d in dates], "eval_date date"), 9, 0.1, 0.75, k=k).collect()
    assert len(got) == len(dates)
    for r in got:
        (q1, n), (q3, _) = wanted(rows, r["eval_date"], 9, 0.1), wanted(rows, r["eval_date"], 9, 0.75)
        assert r["n_points"] == n and r["q1"] == pytest.approx(q1) and r["q3"] == pytest.approx(q3)


def test_sketched_thresholds_have_the_ranks_they_should(spark):
    rows, k = series(5, 30_000, 20), 200
    dates = [DAY0 + dt.timedelta(days=d) for d in (5, 9, 15, 19)]
    got = S.thresholds(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(d,) for d in dates], "eval_date date"), 7, exact=False, k=k).collect()
    worst = 0
    for r in got:
        own = np.sort([x[3] for x in rows if r["eval_date"] - dt.timedelta(days=7) <= x[2] <= r["eval_date"] and x[3] > 1e-5])
        worst = max(worst, *(abs(np.searchsorted(own, r[c]) / len(own) - p) for c, p in (("q1", .1), ("q3", .75))))
    assert 0 < worst < 2 * 2.3 / k**0.9


def test_window_pairs_without_a_nested_loop(spark):
    rows, dates = series(6, 200), [DAY0 + dt.timedelta(days=d) for d in (-8, 0, 7, 7, 30, 41)]
    points, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(d,) for d in set(dates)], "eval_date date")
    met = S.in_windows(told, points, 5, 3)
    assert sorted((r["eval_date"], r["seq"]) for r in met.collect()) == sorted((d, x[1]) for d in set(dates) for x in rows if d - dt.timedelta(days=5) <= x[2] <= d + dt.timedelta(days=3))
    plan = S.classify_signals(points, told, 2, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_points(spark):
    got = S.thresholds(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(DAY0,)], "eval_date date"), 7).collect()
    assert [tuple(r) for r in got] == [(DAY0, 0.0, 0.0, 0)]
