"""Streams: timers against the batch series, in several runs and orders; merges that restart."""

import contextlib
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.operators.written import scratch
from tidemark.plans import reports, trends
from tidemark.streaming import streams

DAY0 = dt.date(2024, 1, 1)


def log_rows(seed, g):
    """Topics with gaps of all lengths, several merges in a step, one topic that merges once."""
    r = random.Random(seed)
    rows = [(DAY0 + dt.timedelta(days=g * i), t, t2, 3 + i, r.randint(1, 9)) for t in range(6) for i in range(20) if r.random() < (.15, .3, .5, .8, .9, 0)[t] for t2 in range(r.choice([1, 1, 2]))]
    return rows + [(DAY0, 6, 0, 4, 1)]


@pytest.mark.parametrize("seed, g, cuts", [(1, 2, (0, 12, 25, 60)), (2, 3, (0, 60))])
def test_timers_give_the_batch_series(spark, seed, g, cuts):
    rows = log_rows(seed, g)
    log = spark.createDataFrame(rows, "merge_ts date, topic1 long, topic2 int, document_count1 long, document_count2 long").withColumns({"count1": F.col("document_count1"), "count2": F.col("document_count2")})
    batch = sorted((r["topic"], str(r["ts"]), round(r["popularity"], 9)) for r in S.signal_popularity(log, g).collect())
    path, sink, progress = (scratch(spark, x) for x in ("in", "sink", "progress"))
    seen, told = set(), []
    for ts, topic, topic2, base, amount in sorted(rows):
        # the stream has no topic2: of several merges in a step the smaller comes first
        told.append((topic, ts, float(base) if topic not in seen else None, float(amount)))
        seen.add(topic)
    last = max(r[0] for r in rows)
    told.append((-1, last + dt.timedelta(days=2 * g + 1), None, None))
    for a, b in zip(cuts, (*cuts[1:], 1000)):
        part = [t for t in told if a <= (t[1] - DAY0).days < b]
        if part:
            random.Random(seed).shuffle(part)
            spark.createDataFrame(part, "topic long, step date, base double, amount double").withColumn("step", F.col("step").cast("timestamp")).write.mode("append").json(path)
        feed = streams.stream_feed(spark, path, "topic long, step timestamp, base double, amount double")
        got = streams.drain(streams.popularity_timers(feed, g), sink, progress, provider=streams.ROCKSDB)
    streamed = sorted((r["topic"], str(r["ts"]), round(r["popularity"], 9)) for r in got.collect())
    assert [s[:2] for s in streamed] == [b[:2] for b in batch]
    # the order of merges within a step may differ, what stands after the step may not
    assert {(t, ts): p for t, ts, p in streamed} == {(t, ts): p for t, ts, p in batch}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != streams.ROCKSDB


def test_forgotten_topics_start_anew(spark):
    path, sink, progress = (scratch(spark, x) for x in ("in", "sink", "progress"))
    rows = [(1, "2024-01-01", 5.0, 1.0), (-1, "2024-03-01", None, None)]
    for part in (rows, [(1, "2024-03-05", None, 2.0)]):
        spark.createDataFrame(part, "topic long, step string, base double, amount double").withColumn("step", F.col("step").cast("timestamp")).write.mode("append").json(path)
        got = streams.drain(streams.popularity_timers(streams.stream_feed(spark, path, "topic long, step timestamp, base double, amount double"), 2, 0.1, forget=1e-3), sink, progress, provider=streams.ROCKSDB)
    told = got.orderBy("ts").collect()
    assert [r["popularity"] for r in told[-2:]] == [0.0, 2.0] and min(r["popularity"] for r in told[:-2]) < 1e-3


def test_counts_go_on_after_a_restart(spark):
    path, home, progress = (scratch(spark, x) for x in ("in", "home", "progress"))

    def run():
        return sorted(tuple(r) for r in streams.merge_counts(streams.stream_feed(spark, path, "topic long"), ["topic"], home, progress).collect())

    spark.createDataFrame([(1,), (1,), (2,)], "topic long").write.mode("append").json(path)
    assert run() == [(1, 2), (2, 1)] == run()
    spark.createDataFrame([(2,), (3,)], "topic long").write.mode("append").json(path)
    assert run() == [(1, 2), (2, 2), (3, 1)] == run()


def test_periods_go_on_after_a_restart_and_an_empty_batch(spark):
    path, home, progress = (scratch(spark, x) for x in ("in", "home", "progress"))
    schema = "period date, topic int, embedding array<double>, count long, document_count long, sources array<string>"
    row = lambda day, topic, v, n: (DAY0 + dt.timedelta(days=day), topic, v, n, n, ["s"])

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        feed = spark.readStream.schema(schema).parquet(path)
        return sorted((r["topic"], r["document_count"]) for r in streams.merge_periods(feed, 0.7, home, progress).collect())

    assert run([]) == []
    assert run([row(0, 0, [1.0, 0.0], 3), row(0, 1, [0.0, 1.0], 2)]) == [(0, 3), (1, 2)]
    assert run([row(7, 0, [0.0, 1.0], 4), row(14, 0, [-1.0, 0.1], 1)]) == [(0, 3), (1, 6), (2, 1)]
    assert run([row(7, 0, [0.0, 1.0], 4)]) == [(0, 3), (1, 6), (2, 1)]  # late


def test_topics_share_the_state_of_their_bucket(spark):
    """A state and a timer for each bucket rather than each topic; the series is the same, also where few topics of a bucket are due."""
    g, told = 2, {}
    rows = [r for r in log_rows(7, g)]
    for buckets in (1, 1000):
        path, sink, progress = (scratch(spark, x) for x in ("in", "sink", "progress"))
        seen, all_rows = set(), []
        for ts, topic, _, base, amount in sorted(rows):
            all_rows.append((topic, ts, None if topic in seen else float(base), float(amount)))
            seen.add(topic)
        all_rows.append((-1, max(r[0] for r in rows) + dt.timedelta(days=2 * g + 1), None, None))
        spark.createDataFrame(all_rows, "topic long, step date, base double, amount double").withColumn("step", F.col("step").cast("timestamp")).write.json(path)
        feed = streams.stream_feed(spark, path, "topic long, step timestamp, base double, amount double")
        got = streams.drain(streams.popularity_timers(feed, g, buckets=buckets), sink, progress, provider=streams.ROCKSDB)
        told[buckets] = sorted(map(str, got.collect()))
        with streams.setting(spark, "spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB):
            held = spark.read.format("statestore").option("stateVarName", "series").load(progress).count()
        assert held == (1 if buckets == 1 else len(seen))
    assert told[1] == told[1000] and len(told[1]) > 40


def test_runs_of_many_files_lose_no_rows(spark, small):
    """Runs of more files than two batches used to take: rows of the third batch were late, and topics idle whose merges were still to come."""
    files = [("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "20"), ("spark.sql.files.maxPartitionBytes", "2k"), ("spark.sql.files.openCostInBytes", "2k"), ("spark.sql.files.minPartitionNum", "20")]
    with contextlib.ExitStack() as held:
        for name, value in files:
            held.enter_context(streams.setting(spark, name, value))
        series = sorted((r["topic"], r["ts"], r["popularity"]) for r in trends.signal_popularity(spark, small).collect())
        got = sorted((r["topic"], r["ts"], r["popularity"]) for r in reports.stream_popularity_state(spark, small).collect())
        assert got == series and len(got) > 100
        late = sorted((str(r["period"]), r["source"], r["n"]) for r in reports.stream_late_data(spark, small).collect())
    assert late == sorted((str(r["period"]), r["source"], r["n"]) for r in reports.stream_late_data(spark, small).collect())
