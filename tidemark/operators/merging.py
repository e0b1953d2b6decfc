"""Matching the topics of a period against the registry of all topics so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.topics import best_match
from tidemark.operators.written import save, scratch

LOG = "merge_ts date, topic1 long, topic2 int, similarity double, count1 long, count2 long, document_count1 long, document_count2 long, sources1 array<string>, sources2 array<string>"


def merge_step(registry: DataFrame, topics: DataFrame, previous: str, minimum: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new registry, merge log, new topics) of one period.

    registry: topic, birth, embedding, count, document_count, sources. topics: the period's topic, embedding, count, document_count,
    sources. Each period topic goes to its nearest registry topic (ties: the smaller id) if the cosine reaches the
    minimum; the others get the next ids in topic order. Logs carry the previous period's date. A registry vector never changes after birth;
    sources1 are those before this merge.
    """
    near = best_match(topics.withColumnRenamed("topic", "topic2"), registry.withColumnRenamed("topic", "topic1"), "topic2", "topic1", "embedding", "embedding")
    found = save(topics.withColumnRenamed("topic", "topic2").join(near, "topic2", "left").withColumn("similarity", F.coalesce("similarity", F.lit(-1.0))), "matched")
    merged, fresh = found.filter(F.col("similarity") >= minimum), found.filter(F.col("similarity") < minimum)
    date = F.lit(previous).cast("date")
    before = registry.select(F.col("topic").alias("topic1"), F.col("count").alias("count1"), F.col("document_count").alias("document_count1"), F.col("sources").alias("sources1"))
    log = merged.join(before, "topic1").select(date.alias("merge_ts"), "topic1", "topic2", "similarity", "count1", F.col("count").alias("count2"), "document_count1", F.col("document_count").alias("document_count2"), "sources1", F.col("sources").alias("sources2"))
    top = registry.agg(F.max("topic").alias("__top"))
    born = fresh.crossJoin(F.broadcast(top)).select((F.col("__top") + F.row_number().over(Window.orderBy("topic2"))).alias("topic"), date.alias("birth"), "embedding", "count", "document_count", "sources")
    gain = merged.groupBy(F.col("topic1").alias("topic")).agg(F.sum("count").alias("c"), F.sum("document_count").alias("d"), F.flatten(F.collect_list("sources")).alias("s"))
    grown = registry.join(gain, "topic", "left").select("topic", "birth", "embedding", (F.col("count") + F.coalesce("c", F.lit(0))).alias("count"), (F.col("document_count") + F.coalesce("d", F.lit(0))).alias("document_count"), F.sort_array(F.array_distinct(F.concat("sources", F.coalesce("s", F.array().cast("array<string>"))))).alias("sources"))
    return grown.unionByName(born), log, born


def merge_all_periods(topics: DataFrame, minimum: float, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Fold the periods in time order: (registry, merge log). Each step's few rows are written by ``save``, the logs of all steps to
    one table."""
    spark = topics.sparkSession
    dates = [r["period"] for r in topics.select("period").distinct().orderBy("period").collect()]
    topics, logs = save(topics, "period_topics"), scratch(spark, "merge_logs")
    registry = None
    for previous, period in zip([None, *dates], dates):
        own = topics.filter(F.col("period") == F.lit(period)).drop("period")
        if registry is None:
            registry = save(own.select(F.col("topic").cast("long").alias("topic"), F.lit(str(period)).cast("date").alias("birth"), "embedding", "count", "document_count", "sources"), "registry")
            continue
        grown, log, _ = merge_step(registry, own, str(previous), minimum)
        registry = save(grown, "registry")
        log.write.mode("append").parquet(logs)
    if len(dates) < 2:
        spark.createDataFrame([], LOG).write.parquet(logs)
    return registry, spark.read.schema(LOG).parquet(logs)
