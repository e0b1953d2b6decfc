"""Feeds as streams: new files, deduplication, counts by period, sliding and session windows, state with decay, merging."""

from __future__ import annotations

import contextlib
import datetime as dt
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merging import merge_step
from tidemark.operators.written import save

#: The state store that holds timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_feed(spark: SparkSession, path: str, schema: str, files: int | None = 8) -> DataFrame:
    """New json lines files of a folder as a stream, so many in a batch; without ``files`` all that are there, where files hold rows of the same time.

    Files that are written side by side come in any order. Batches that take some of them move the watermark past the rows of the others, which count as late."""
    feed = spark.readStream.schema(schema)
    return (feed if files is None else feed.option("maxFilesPerTrigger", files)).json(path)


def stream_dedupe(df: DataFrame, key: str, delay: str, ts: str = "ts") -> DataFrame:
    """The first row of each key within the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def period_counts(df: DataFrame, days: int, keys: list[str], origin: str = "0 days", delay: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows and (approximately) distinct documents by tumbling periods; rows later than the delay are dropped."""
    df = df.withWatermark(ts, delay or f"{days} days")
    by = df.groupBy(F.window(ts, f"{days} days", startTime=origin), *keys)
    return by.agg(F.count("*").alias("n"), F.approx_count_distinct("document_id").alias("documents")).select(F.col("window.start").alias("period"), *keys, "n", "documents")


def sliding_counts(df: DataFrame, window: str, slide: str, keys: list[str], delay: str = "2 days", ts: str = "ts") -> DataFrame:
    df = df.withWatermark(ts, delay)
    return df.groupBy(F.window(ts, window, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, gap: str, keys: list[str], delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Bursts of activity of each key, ended by an idle gap."""
    df = df.withWatermark(ts, delay)
    return df.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def popularity_timers(df: DataFrame, g: int, factor: float = 0.01, power: float = 2.0, delay: str = "0 days", forget: float = 0.0, buckets: int = 512) -> DataFrame:
    """topic, ts, kind (0 first, 1 merge, 2 idle), popularity: the series of signal_popularity, from a stream of merges.

    ``df``: topic, step (midnight of the merge's date), base (documents of the topic before its first merge), amount. What is held of a topic
    is its popularity, last step and idle steps since. It is due once the watermark shows that neither its next idle step nor the step
    after it (before which nothing decays) has a merge: the idle step is emitted then. A row without amount is a
    clock that only moves the watermark. Topics whose popularity falls below ``forget`` lose their state and start anew with their next merge.
    The steps of a topic in one batch may come in any order, those of a batch come after all that were in batches before it (``stream_feed`` without
    a number of files); needs a state store that holds timers (``ROCKSDB``).

    Topics are dealt over ``buckets`` by their hash. A bucket has one state, four numbers a topic, and one event-time timer at the first
    time that a topic of it is due, as a call to the state store costs far more than what a topic needs; the number of buckets stays for the stream's life.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    day_ms = 86_400_000

    class Series(StatefulProcessor):  # defined here, so that it travels by value
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("series", "topic array<long>, popularity array<double>, last array<long>, idle array<long>")

        def held(self) -> dict:
            return {t: (p, last, idle) for t, p, last, idle in zip(*self.state.get())} if self.state.exists() else {}

        def keep(self, held: dict) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not held:
                self.state.clear()
                return
            self.state.update((list(held), *map(list, zip(*held.values()))))
            self.handle.registerTimer(min(self.due(last, idle) for _, last, idle in held.values()))

        def due(self, last: int, idle: int) -> int:
            return (last + g * (idle + 3)) * day_ms

        def idle_steps(self, topic: int, popularity: float, last: int, idle: int, until: int, out: list) -> tuple[float, int]:
            """Idle steps up to the day ``until``."""
            while last + g * (idle + 2) <= until:
                idle += 1
                popularity *= math.exp(-factor * idle**power)
                out.append((topic, last + g * (idle + 1), 2, popularity))
            return popularity, idle

        def told(self, out: list) -> pd.DataFrame:
            topic, day, kind, popularity = zip(*out) if out else ((), (), (), ())
            dates = {d: dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in set(day)}
            return pd.DataFrame({"topic": pd.Series(topic, dtype="int64"), "ts": [dates[d] for d in day], "kind": pd.Series(kind, dtype="int32"), "popularity": pd.Series(popularity, dtype="float64")})

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows))
            batch = batch[batch["amount"].notna()]
            if not len(batch):
                return
            batch = batch.assign(day=(batch["step"] - pd.Timestamp(0)) // pd.Timedelta(days=1)).sort_values(["topic", "day", "base", "amount"])
            held, out = self.held(), []
            for topic, day, base, amount in zip(*(batch[c].tolist() for c in ("topic", "day", "base", "amount"))):
                if topic not in held:
                    popularity = 0.0 if math.isnan(base) else base
                    out.append((topic, day, 0, popularity))
                else:
                    popularity, _ = self.idle_steps(topic, *held[topic], day - 2 * g, out)
                held[topic] = (float(popularity + amount), day, 0)
                out.append((topic, day + g, 1, popularity + amount))
            self.keep(held)
            yield self.told(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now, held, out = timerValues.getCurrentWatermarkInMs(), self.held(), []
            for topic, (popularity, last, idle) in list(held.items()):
                due = self.due(last, idle)
                if due < now or due <= expiredTimerInfo.getExpiryTimeInMs():
                    popularity, idle = self.idle_steps(topic, popularity, last, idle, now // day_ms - g, out)
                    held[topic] = (popularity, last, idle)
                    if popularity < forget:
                        del held[topic]
            self.keep(held)
            yield self.told(out)

        def close(self) -> None:
            pass

    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("topic"), F.lit(buckets))).withWatermark("step", delay)
    return dealt.groupBy("bucket").transformWithStateInPandas(Series(), "topic long, ts date, kind int, popularity double", "Append", "EventTime")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str | None):
    """The session with another value of a setting, for as long as the block runs."""
    before = spark.conf.get(name, None)
    if value is not None:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give the written rows; ``provider`` is the state store to use."""
    with setting(df.sparkSession, "spark.sql.streaming.stateStore.providerClass", provider):
        run = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def for_each_batch(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch to ``step`` (batch, id); steps write by batch id, so a repeated batch changes nothing."""
    df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def version(home: str, batch_id: int) -> str:
    return f"{home}/version={batch_id}"


def newest(spark: SparkSession, home: str, before: int | None = None) -> DataFrame:
    """The newest version of a table that batches write; the folder alone says which there are, so a restart finds them."""
    held = spark.read.parquet(home)
    if before is not None:
        held = held.filter(F.col("version") < before)
    return held.filter(F.col("version") == held.agg(F.max("version")).first()[0]).drop("version")


def merge_counts(df: DataFrame, keys: list[str], home: str, checkpoint: str) -> DataFrame:
    """Counts by key, merged batch by batch; each batch writes the version of its id, so a repeated batch changes nothing."""
    def step(batch: DataFrame, batch_id: int) -> None:
        own = batch.groupBy(*keys).agg(F.count("*").alias("n"))
        if batch_id:
            own = own.unionByName(newest(batch.sparkSession, home, batch_id)).groupBy(*keys).agg(F.sum("n").alias("n"))
        own.write.mode("overwrite").parquet(version(home, batch_id))

    for_each_batch(df, step, checkpoint)
    return newest(df.sparkSession, home)


def merge_periods(df: DataFrame, minimum: float, home: str, checkpoint: str) -> DataFrame:
    """Merge a stream of period topics (period, topic, embedding, count, document_count, sources) into a registry, period by period.

    Each micro-batch reads the registry that the one before it wrote and writes its own under its id, with the last
    period merged so far, so a repeated batch changes nothing and a restart goes on where the last run ended. Periods have to arrive in
    order; those of one batch are sorted, and those up to the last one merged are left out as late.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        topics = batch.persist()
        registry = topics.select(F.col("topic").cast("long").alias("topic"), F.col("period").alias("birth"), "embedding", "count", "document_count", "sources").limit(0)
        previous = None
        if batch_id:
            held = newest(batch.sparkSession, home, batch_id)
            registry, previous = held.drop("upto"), held.agg(F.max("upto")).first()[0]
        for (period,) in topics.select("period").distinct().orderBy("period").collect():
            own = topics.filter(F.col("period") == F.lit(period)).drop("period")
            if previous is None:
                registry = own.select(F.col("topic").cast("long").alias("topic"), F.lit(period).alias("birth"), "embedding", "count", "document_count", "sources")
            elif period > previous:
                registry = save(merge_step(registry, own, str(previous), minimum)[0], "registry")
            previous = period if previous is None else max(previous, period)
        registry.withColumn("upto", F.lit(previous).cast(df.schema["period"].dataType)).write.mode("overwrite").parquet(version(home, batch_id))
        topics.unpersist()

    for_each_batch(df, step, checkpoint)
    return newest(df.sparkSession, home).drop("upto")
