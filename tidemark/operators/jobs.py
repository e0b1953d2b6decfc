"""The periodic job: take in new periods, merge their topics, label the signals, and write all of it so that it can be run again.

A job has a folder with four tables, each by period: ``registry`` (all topics after the period), ``log`` (its merges),
``signals`` (labels at its date, by category) and ``finished`` (one row). What a period writes replaces what an earlier, perhaps interrupted, run wrote for
it, and the row in ``finished`` comes last. Readers look at finished periods only; a later run starts from the newest of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import signals as S
from tidemark.operators.merging import LOG, merge_step

REGISTRY = "topic long, birth date, embedding array<double>, count long, document_count long, sources array<string>"
SIGNALS = "topic long, popularity double, latest_ts date, docs_count long, rising boolean, category string"
#: The folders of a job, by what they hold.
TABLES = {"registry": REGISTRY, "log": LOG, "signals": SIGNALS, "finished": "rows long"}


def put(df: DataFrame, home: str, table: str, period: str, by: str | None = None) -> None:
    """Write a period's part of a table in place of what is there."""
    kinds = [c for c in df.columns if c != by]
    writer = df.select(*kinds, *([by] if by else [])).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{home}/{table}/period={period}")


def finished(spark: SparkSession, home: str) -> list[str]:
    """The periods that are wholly written, in order; there is one row a period."""
    try:
        held = spark.read.schema("rows long, period string").parquet(f"{home}/finished")
        return sorted(r["period"] for r in held.select("period").distinct().collect())
    except Exception as e:  # a folder that no run has made yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def held(spark: SparkSession, home: str, table: str, periods: list[str]) -> DataFrame:
    """The parts of a table that belong to ``periods``, with ``period``."""
    schema = f"{TABLES[table]}, period string"
    if not periods:
        return spark.createDataFrame([], schema)
    paths = [f"{home}/{table}/period={p}" for p in periods]
    return spark.read.schema(schema).option("basePath", f"{home}/{table}").parquet(*paths)


def advance(spark: SparkSession, topics: DataFrame, home: str, minimum: float, g: int, window: int, until: str | None = None) -> list[str]:
    """Take in every period of ``topics`` (period, topic, embedding, count, document_count, sources) after the last finished one, up to
    ``until``; the periods taken in.

    The first period becomes the registry; each later one is merged with the registry of the one before it, and the signals at the
    date of the merge (the period before) are labelled from the log of all merges so far. Periods that aren't after the last finished one are left as they are.
    """
    done = finished(spark, home)
    dates = [str(r["period"]) for r in topics.select("period").distinct().orderBy("period").collect()]
    taken = []
    for period in dates:
        if done and period <= done[-1] or until is not None and period > until:
            continue
        own = topics.filter(F.col("period") == F.lit(period).cast("date")).drop("period")
        if done:
            registry = held(spark, home, "registry", done[-1:]).drop("period")
            grown, log, _ = merge_step(registry, own, done[-1], minimum)
            put(log, home, "log", period)
            merges = held(spark, home, "log", [*done[1:], period]).drop("period")
        else:
            grown = own.select(F.col("topic").cast("long").alias("topic"), F.lit(period).cast("date").alias("birth"), "embedding", "count", "document_count", "sources")
            put(spark.createDataFrame([], LOG), home, "log", period)
            merges = None
        put(grown.select(*[f.split()[0] for f in REGISTRY.split(", ")]), home, "registry", period)
        if merges is not None and not merges.isEmpty():
            series = S.signal_popularity(merges, g)
            date = spark.range(1).select(F.lit(done[-1]).cast("date").alias("eval_date"))
            told = S.classify_signals(series, date, g, window)
        else:
            told = spark.createDataFrame([], SIGNALS)
        put(told.select(*[f.split()[0] for f in SIGNALS.split(", ")]), home, "signals", period, by="category")
        put(spark.range(1).select(F.lit(held(spark, home, "registry", [period]).count()).alias("rows")), home, "finished", period)
        done.append(period)
        taken.append(period)
    return taken


def result(spark: SparkSession, home: str, table: str) -> DataFrame:
    """A job's table over its finished periods; of the registry, the newest."""
    done = finished(spark, home)
    return held(spark, home, table, done[-1:] if table == "registry" else done)
