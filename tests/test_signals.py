"""Series and labels against a literal simulation of the time steps."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merging, signals as S

DAY0 = dt.date(2024, 1, 1)


def simulate(rows, g, factor, power):
    """Walk all grid steps, topic by topic, as the definition says."""
    first, last = min(r[0] for r in rows), max(r[0] for r in rows)
    steps = [first + dt.timedelta(days=g * i) for i in range(((last - first).days + g) // g + 1)]
    series, popularity, updated = {}, {}, {}
    for now in steps:
        active = set()
        for ts, t1, t2, d1, d2 in sorted(r for r in rows if r[0] == now):
            active.add(t1)
            if t1 not in series:
                series[t1], popularity[t1] = [(now, float(d1))], float(d1)
            popularity[t1] += d2
            updated[t1] = now + dt.timedelta(days=g)
            series[t1].append((updated[t1], popularity[t1]))
        coming = {r[1] for r in rows if r[0] == now + dt.timedelta(days=g)}
        for t in set(updated) - active - coming:
            n = (now - updated[t]).days // g
            if n > 0:
                popularity[t] *= math.exp(-factor * n**power)
                series[t].append((now, popularity[t]))
    return series


@pytest.mark.parametrize("seed", range(4))
def test_series_equals_simulation(spark, seed):
    r, g = random.Random(seed), 2
    rows = [(DAY0 + dt.timedelta(days=g * i), t, t2, 5 + i, r.randint(1, 9)) for i in range(12) for t in range(5) for t2 in range(r.choice([0, 0, 0, 1, 2]))]
    log = spark.createDataFrame(rows, "merge_ts date, topic1 long, topic2 int, document_count1 long, document_count2 long").withColumns({"count1": F.col("document_count1"), "count2": F.col("document_count2")})
    got = {}
    for x in S.signal_popularity(log, g).orderBy("topic", "seq").collect():
        got.setdefault(x["topic"], []).append((x["ts"], x["popularity"]))
    wanted = simulate(rows, g, 0.01, 2)
    assert {t: [p[0] for p in s] for t, s in got.items()} == {t: [p[0] for p in s] for t, s in wanted.items()}
    for t, s in wanted.items():
        assert [p[1] for p in got[t]] == pytest.approx([p[1] for p in s])


@pytest.mark.parametrize("values, rising", [([.1, .2, .3], True), ([.3, .2, .1], False), ([.2, .2, .2], False), ([.4], True)])
def test_rising(spark, values, rising):
    rows = [(0, i, DAY0 + dt.timedelta(days=7 * i), v, 1, 1) for i, v in enumerate(values)]
    series = spark.createDataFrame(rows, "topic long, seq int, ts date, popularity double, docs_count long, paragraphs_count long")
    dates = spark.createDataFrame([(rows[-1][2],)], "eval_date date")
    got = S.classify_signals(series, dates, 7, 14).first()
    assert got["rising"] == rising and got["q1"] <= got["q3"]


def test_thresholds_of_window(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    rows = [(0, 0, d(0), .5, 1, 1), (0, 1, d(7), .7, 1, 1), (1, 0, d(0), .3, 1, 1), (1, 1, d(14), .2, 1, 1)]
    series = spark.createDataFrame(rows, "topic long, seq int, ts date, popularity double, docs_count long, paragraphs_count long")
    got = S.thresholds(series, spark.createDataFrame([(d(14),), (d(400),)], "eval_date date"), 14).orderBy("eval_date").collect()
    assert got[0]["n_points"] == 4 and got[0]["q3"] > got[0]["q1"] > 0
    assert (got[1]["q1"], got[1]["q3"], got[1]["n_points"]) == (0, 0, 0)


def test_merge_step_merges_or_mints(spark):
    schema = "topic long, birth date, embedding array<double>, count long, document_count long, sources array<string>"
    registry = spark.createDataFrame([(0, DAY0, [1.0, 0.0], 2, 2, ["a"]), (1, DAY0, [0.0, 1.0], 1, 1, ["b"])], schema)
    topics = spark.createDataFrame([(0, [0.99, 0.05], 1, 1, ["c"]), (1, [0.7, -0.7], 4, 3, ["d"])], "topic int, embedding array<double>, count long, document_count long, sources array<string>")
    grown, log, born = merging.merge_step(registry, topics, "2024-01-01", 0.9)
    assert sorted((r["topic"], r["count"], r["document_count"]) for r in grown.collect()) == [(0, 3, 3), (1, 1, 1), (2, 4, 3)]
    assert [(r["topic1"], r["topic2"], r["sources1"]) for r in log.collect()] == [(0, 0, ["a"])]
    assert [r["topic"] for r in born.collect()] == [2]


def test_links_and_zero_shot(spark):
    info = spark.createDataFrame([(DAY0, "a", 3), (DAY0 + dt.timedelta(days=4), "a", 2)], "ts date, name string, document_count long")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    got = {(r["name"], r["ts"].day): r["popularity"] for r in S.zeroshot_trend(info, names, 2).collect()}
    assert got[("a", 3)] == pytest.approx(3 * math.exp(-0.01)) and got[("a", 5)] == pytest.approx(3 * math.exp(-0.01) + 2) and got[("b", 5)] == 0
