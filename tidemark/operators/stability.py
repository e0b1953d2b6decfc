"""Topics over time and how steady they are: words and vectors of a topic from one time to the next."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import topics as O
from tidemark.operators.signals import decayed_totals
from tidemark.operators.written import save


def scores_over_time(counts: DataFrame, global_counts: DataFrame) -> DataFrame:
    """topic, ts, term, score: shares of a topic's words at a time, weighted by the terms' global rarity."""
    total = counts.groupBy("topic", "ts").agg(F.sum("n").alias("__w"))
    mean = global_counts.groupBy("topic").agg(F.sum("n").alias("w")).agg(F.floor(F.avg("w")).alias("__a"))
    f = global_counts.groupBy("term").agg(F.sum("n").alias("__f"))
    rows = counts.join(total, ["topic", "ts"]).withColumn("tf", F.sqrt(F.col("n") / F.col("__w"))).join(f, "term").crossJoin(F.broadcast(mean))
    return rows.select("topic", "ts", "term", (F.col("tf") * F.log(1 + F.col("__a") / F.col("__f"))).alias("score"))


def evolution_tuning(scores: DataFrame) -> DataFrame:
    """Each topic's scores as the mean with the tuned ones of the time just before, if the topic is there.

    Within a run of consecutive times the tuned score is a sum of earlier scores with halving weights: a running sum over the times from the
    term's first one in the run on.
    """
    times = scores.select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")))
    seen = scores.select("topic", "ts").distinct().join(F.broadcast(times), "ts")
    run = F.col("k") - F.row_number().over(Window.partitionBy("topic").orderBy("k"))
    spans = seen.withColumn("run", run)
    ends = spans.groupBy("topic", "run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    rows = scores.join(spans, ["topic", "ts"]).join(ends, ["topic", "run"])
    rows = save(rows.select("topic", "run", "term", "k", "k1", F.when(F.col("k") == F.col("k0"), F.col("score")).otherwise(F.col("score") / 2).alias("x")), "scores_in_runs")
    grid = rows.groupBy("topic", "run", "term").agg(F.min("k").alias("first"), F.max("k1").alias("k1")).withColumn("k", F.explode(F.sequence("first", "k1")))
    full = grid.join(rows.select("topic", "run", "term", "k", "x"), ["topic", "run", "term", "k"], "left").withColumns({
        "key": F.struct("topic", "run", "term"), "x": F.coalesce("x", F.lit(0.0)), "halving": F.when(F.col("k") > F.col("first"), math.log(2)).otherwise(0.0)})
    tuned = decayed_totals(full, "key", ["k"], "x", "halving", "score")
    return tuned.join(F.broadcast(times), "k").select("topic", "ts", "term", "score")


def global_tuning(scores: DataFrame, overall: DataFrame) -> DataFrame:
    """Mean with the topic's global scores, normalised to a sum of 1; terms missing on one side count 0 there."""
    total = overall.groupBy("topic").agg(F.sum("score").alias("__w"))
    base = overall.join(total, "topic").select("topic", "term", (F.col("score") / F.col("__w")).alias("g"))
    times = scores.select("topic", "ts").distinct().join(base, "topic")
    return scores.join(times, ["topic", "ts", "term"], "full").select("topic", "ts", "term", ((F.coalesce("score", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))) / 2).alias("score"))


def embedding_stability(rows: DataFrame, window: int = 2) -> DataFrame:
    """topic, start_ts, end_ts, score: cosine of a topic's vector with that ``window`` - 1 times later.

    Topics with too few times get one row of score 0 without time stamps.
    """
    if window < 2:
        raise ValueError("a window has two times at least")
    w = Window.partitionBy("topic").orderBy("ts")
    pairs = rows.withColumn("end_ts", F.lead("ts", window - 1).over(w)).withColumn("e2", F.lead("embedding", window - 1).over(w)).filter("end_ts is not null")
    scored = pairs.select("topic", F.col("ts").alias("start_ts"), "end_ts", V.cosine(F.col("embedding"), F.col("e2")).alias("score"))
    few = rows.select("topic").distinct().join(scored.select("topic").distinct(), "topic", "left_anti")
    null = F.lit(None).cast(dict(rows.dtypes)["ts"])
    return scored.unionByName(few.select("topic", null.alias("start_ts"), null.alias("end_ts"), F.lit(0.0).alias("score")))


def representation_stability(rows: DataFrame, window: int = 2, k: int = 2) -> DataFrame:
    """topic, start_ts, end_ts, score: for each word vector of the start the mean of its k best cosines to the end's words, averaged.

    ``rows``: topic, ts, word_vectors (array of vectors).
    """
    w = Window.partitionBy("topic").orderBy("ts")
    pairs = rows.withColumn("end_ts", F.lead("ts", window - 1).over(w)).withColumn("v2", F.lead("word_vectors", window - 1).over(w)).filter("end_ts is not null")

    def best(x: Column) -> Column:
        near = F.slice(F.sort_array(F.transform("v2", lambda y: F.coalesce(V.cosine(x, y), F.lit(0.0))), False), 1, k)
        return F.aggregate(near, F.lit(0.0), lambda a, s: a + s) / F.size(near)

    each = F.transform("word_vectors", best)
    scored = pairs.select("topic", F.col("ts").alias("start_ts"), "end_ts", (F.aggregate(each, F.lit(0.0), lambda a, s: a + s) / F.size(each)).alias("score"))
    few = rows.select("topic").distinct().join(scored.select("topic").distinct(), "topic", "left_anti")
    null = F.lit(None).cast(dict(rows.dtypes)["ts"])
    return scored.unionByName(few.select("topic", null.alias("start_ts"), null.alias("end_ts"), F.lit(0.0).alias("score")))


def overall_stability(embedding: DataFrame, representation: DataFrame, alpha: float = 0.5) -> DataFrame:
    """topic, score, timestamps, normalised: alpha times embedding plus the rest of representation stability, averaged by topic, and scaled to [0, 1]
    over all topics (null if all are equal). Null time stamps match each other."""
    a, b = embedding.alias("a"), representation.alias("b")
    met = a.join(b, (F.col("a.topic") == F.col("b.topic")) & F.col("a.start_ts").eqNullSafe(F.col("b.start_ts")) & F.col("a.end_ts").eqNullSafe(F.col("b.end_ts")))
    by_topic = met.groupBy(F.col("a.topic").alias("topic")).agg(F.avg(alpha * F.col("a.score") + (1 - alpha) * F.col("b.score")).alias("score"), F.count("*").alias("timestamps"))
    span = by_topic.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return by_topic.crossJoin(F.broadcast(span)).select("topic", "score", "timestamps", F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")).alias("normalised"))


def similar_topic_pairs(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """ts, topic1 < topic2, similarity of topics at the same time."""
    b = rows.select(F.col("ts").alias("__ts"), F.col("topic").alias("topic2"), F.col("embedding").alias("__e"))
    pairs = rows.join(b, (F.col("ts") == F.col("__ts")) & (F.col("topic") < F.col("topic2")))
    return pairs.select("ts", F.col("topic").alias("topic1"), "topic2", V.cosine(F.col("embedding"), F.col("__e")).alias("similarity")).filter(F.col("similarity") >= least)


def top_words_over_time(scores: DataFrame, k: int = 5) -> DataFrame:
    return O.top_words(scores.filter("score > 0"), ["ts", "topic"], k)
