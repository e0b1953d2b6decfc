"""The periodic job: run at once, in parts, again, and after an interruption."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import jobs, merging
from tidemark.operators.written import save, scratch
from tidemark.sources import files

DAY0 = dt.date(2024, 1, 1)
SCHEMA = "period date, topic int, embedding array<double>, count long, document_count long, sources array<string>"


@pytest.fixture(scope="module")
def topics(spark):
    r = np.random.default_rng(1)
    base = np.eye(6)
    rows = [(DAY0 + dt.timedelta(days=7 * p), t, (base[(t + p * (t % 2)) % 6] + .1 * r.normal(size=6)).tolist(), int(r.integers(5, 30)), int(r.integers(2, 9)), [f"s{p}"]) for p in range(4) for t in range(4)]
    return spark.createDataFrame(rows, SCHEMA)


def everything(spark, home):
    return {t: sorted(map(str, jobs.result(spark, home, t).collect())) for t in ("registry", "log", "signals", "finished")}


@pytest.fixture(scope="module")
def whole(spark, topics):
    home = scratch(spark, "whole")
    assert len(jobs.advance(spark, topics, home, 0.7, 7, 21)) == 4
    return everything(spark, home)


def test_job_equals_the_batch_fold(spark, topics, whole):
    registry, log = merging.merge_all_periods(topics, 0.7, save)
    assert sorted((r["topic"], r["document_count"]) for r in registry.collect()) == sorted((int(r.split("topic=")[1].split(",")[0]), int(r.split("document_count=")[1].split(",")[0])) for r in whole["registry"])
    assert log.count() == len(whole["log"]) > 5 and len(whole["signals"]) > 3 and len(whole["finished"]) == 4


def test_parts_and_repeats_give_the_same(spark, topics, whole):
    home = scratch(spark, "parts")
    assert jobs.advance(spark, topics, home, 0.7, 7, 21, until="2024-01-08") == ["2024-01-01", "2024-01-08"]
    assert jobs.advance(spark, topics, home, 0.7, 7, 21, until="2024-01-08") == []
    assert len(jobs.advance(spark, topics, home, 0.7, 7, 21)) == 2 and jobs.advance(spark, topics, home, 0.7, 7, 21) == []
    assert everything(spark, home) == whole


@pytest.mark.parametrize("broken", ["signals"])
def test_interrupted_runs_give_the_same(spark, topics, whole, monkeypatch, broken):
    """A run dies while it writes a table of the third period, after other data were written there."""
    home, put = scratch(spark, "broken"), jobs.put

    def dying(df, home, table, period, by=None):
        if table == broken and period == "2024-01-15":
            if table != "finished":
                put(df.limit(1), home, table, period, by)
            raise RuntimeError("lost")
        put(df, home, table, period, by)

    monkeypatch.setattr(jobs, "put", dying)
    with pytest.raises(RuntimeError):
        jobs.advance(spark, topics, home, 0.7, 7, 21)
    assert jobs.finished(spark, home) == ["2024-01-01", "2024-01-08"]
    monkeypatch.setattr(jobs, "put", put)
    assert len(jobs.advance(spark, topics, home, 0.7, 7, 21)) == 2
    assert everything(spark, home) == whole


def test_signals_of_a_date_are_replaced(spark):
    path = scratch(spark, "signals")
    rows = lambda *r: spark.createDataFrame(r, "reference_ts string, category string, topic long, popularity double")
    files.write_signals(rows(("2024-01-01", "weak", 1, 2.0), ("2024-01-01", "strong", 2, 9.0), ("2024-01-08", "weak", 1, 3.0)), path)
    files.write_signals(rows(("2024-01-08", "strong", 1, 4.0), ("2024-01-15", "noise", 1, 0.0)), path)
    files.write_signals(rows(("2024-01-08", "strong", 1, 4.0)), path)
    got = sorted((str(r["reference_ts"]), r["category"], r["topic"]) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01", "strong", 2), ("2024-01-01", "weak", 1), ("2024-01-08", "strong", 1), ("2024-01-15", "noise", 1)]
