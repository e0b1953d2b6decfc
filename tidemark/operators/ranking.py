"""Stationary weights of sentences of very long documents, worked out by many tasks.

The weight of a sentence is its share of the sum of its connected component in the graph of cosines above zero, times the component's
share of the sentences. Where no vector holds a negative number, a sentence's sum is its product with the sum of its component's vectors, and components are told by
the dimensions that sentences share: every task adds up its own rows. With negative numbers, pairs of blocks of BLOCK sentences meet, each pair in
a task of its own: their products give parts of the sums, and the smallest label among a sentence's neighbours, until no label changes. A task holds two blocks and
their products, BLOCK * BLOCK numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators.written import save

#: Sentences of a block.
BLOCK = 2048


def factored_weights(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, weight of ``rows`` (key, pos, v: no negative numbers; a row of zeros has weight 0)."""
    used = F.filter(F.transform("v", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    rows = save(rows.withColumn("used", used).withColumn("dim", F.array_min("used")), "sentences")
    edges = rows.select(key, F.explode("used").alias("other"), "dim").distinct()  # as many as dimensions squared, for a document
    kind = dict(rows.dtypes)[key]

    def joined(own: pd.DataFrame) -> pd.DataFrame:
        label = {int(d): int(d) for d in {*own["dim"], *own["other"]}}
        moved = True
        while moved:
            moved = False
            for a, b in zip(own["dim"].tolist(), own["other"].tolist()):
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    moved = True
        return pd.DataFrame({key: own[key].iloc[0], "dim": list(label), "label": list(label.values())})

    labels = edges.groupBy(key).applyInPandas(joined, f"`{key}` {kind}, dim int, label int")
    told = save(rows.join(labels, [key, "dim"]).select(key, "pos", "v", "label"), "labelled")
    sums = V.mean_vector(told, [key, "label"], "v", "mean")
    whole = rows.groupBy(key).agg(F.count("*").alias("whole"))
    sums = sums.join(whole, key).select(key, "label", F.transform("mean", lambda x: x * F.col("n")).alias("sum"), (F.col("n") / F.col("whole")).alias("part"))
    met = told.join(sums, [key, "label"])
    weight = F.try_divide(V.dot(F.col("v"), F.col("sum")), V.dot(F.col("sum"), F.col("sum"))) * F.col("part")
    return met.select(key, "pos", F.coalesce(weight, F.lit(0.0)).alias("weight")).unionByName(rows.filter("dim is null").select(key, "pos", F.lit(0.0).alias("weight")))


def block_weights(rows: DataFrame, key: str, spans: list[int], shares: list[float], block: int | None = None) -> DataFrame:
    """key, pos, weight of ``rows`` (key, pos, v), whose vectors hold parts of ``spans`` numbers each: the similarity is the sum of the
    parts' cosines above zero by ``shares``."""
    size = block or BLOCK
    kind = dict(rows.dtypes)[key]
    numbered = rows.withColumn("i", F.floor(F.col("pos") / size).cast("int")).withColumn("label", F.col("pos"))
    now = save(numbered, "blocks")
    ends = np.cumsum([0, *spans])

    def near(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x, y = (np.stack(c.to_numpy()).astype(float) for c in (a["a_v"], b["b_v"]))
        return sum(w * np.maximum(x[:, lo:hi] @ y[:, lo:hi].T, 0) for w, lo, hi in zip(shares, ends, ends[1:]))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({key: [], "pos": [], "degree": [], "label": []})
        s = near(a, b)
        label = np.where(s > 0, b["b_label"].to_numpy()[None], np.iinfo(np.int32).max).min(1)
        return pd.DataFrame({key: a[f"a_{key}"], "pos": a["a_pos"], "degree": s.sum(1), "label": label.astype(np.int32)})

    while True:
        last = now.groupBy(key).agg(F.max("i").alias("__last"))
        wide = now.join(last, key).withColumn("j", F.explode(F.sequence(F.lit(0), "__last"))).drop("__last")
        own = wide.select(*(F.col(c).alias(f"a_{c}") for c in (key, "i", "j", "pos", "v")))  # columns (and ids) of their own on either side
        other = wide.select(*(F.col(c).alias(f"b_{c}") for c in (key, "i", "j", "v", "label")))
        parts = own.groupBy(f"a_{key}", "a_i", "a_j").cogroup(other.groupBy(f"b_{key}", "b_j", "b_i")).applyInPandas(met, f"`{key}` {kind}, pos int, degree double, label int")
        found = parts.groupBy(key, "pos").agg(F.sum("degree").alias("degree"), F.min("label").alias("near"))
        grown = save(now.drop("degree").join(found, [key, "pos"]).withColumn("near", F.least("near", "label")), "labels")
        if grown.filter("near != label").isEmpty():
            break
        now = save(grown.withColumn("label", F.col("near")).drop("near"), "blocks")
    by = grown.groupBy(key, "label").agg(F.sum("degree").alias("total"), F.count("*").alias("n"))
    whole = grown.groupBy(key).agg(F.count("*").alias("whole"))
    weight = F.coalesce(F.try_divide(F.col("degree"), F.col("total")), F.lit(0.0)) * F.col("n") / F.col("whole")
    return grown.join(by, [key, "label"]).join(whole, key).select(key, "pos", weight.alias("weight"))
