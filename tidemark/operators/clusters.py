"""Clusters of the vectors of each period: spherical k-means of all periods at once.

A round is one aggregation with period and centre as key: every task adds up its vectors by their nearest centre, and a row for each key and
task is shuffled. The centres of all periods, a few numbers a period, travel with the tasks. Clusters with few members and
vectors far from their centre are outliers (-1), told by counts and a join rather than by sorting a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators.written import save

#: Vectors of a period among which the first centres are chosen.
SAMPLE = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of unit vectors that lie far apart: the first, then always the one that is least like those chosen."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-9:
            break
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return x[chosen]


def cluster_periods(rows: DataFrame, k: int = 8, rounds: int = 10, least_size: int = 5, least_closeness: float = 0.05) -> DataFrame:
    """period, id, topic (0 to k - 1, or -1) and closeness (cosine with the centre) of ``rows`` (period, id, embedding).

    Vectors that are null, empty, without length or not finite are outliers with null closeness. Reruns agree: the first centres
    are chosen among the SAMPLE vectors of a period with the smallest hash, and ties go to the smaller number.
    """
    period = dict(rows.dtypes)["period"]
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce((V.norm(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)), F.lit(False))
    rows = save(rows.select("period", "id", F.when(sound, v).alias("embedding")), "vectors")
    fine = rows.filter("embedding is not null")
    drawn = fine.withColumn("__n", F.row_number().over(Window.partitionBy("period").orderBy(F.xxhash64("id", "embedding"), "id"))).filter(F.col("__n") <= SAMPLE)

    def first(own: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(own.sort_values("__n")["embedding"].to_numpy()))
        return pd.DataFrame({"period": own["period"].iloc[0], "centre": list(spread_out(x, k))})

    found = drawn.groupBy("period").applyInPandas(first, f"period {period}, centre array<double>").collect()
    centres: dict[object, np.ndarray] = {}
    for r in found:
        centres.setdefault(r["period"], []).append(r["centre"])
    centres = {p: np.array(c) for p, c in centres.items()}

    def nearest(centres: dict, schema: str, keep: list[str]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                topic, closeness = np.zeros(len(b), np.int32), np.zeros(len(b))
                vectors = np.empty(len(b), object)
                for p, at in b.groupby("period", dropna=False).indices.items():
                    x = unit(np.stack(b["embedding"].to_numpy()[at]))
                    near = x @ centres[None if pd.isna(p) else p].T
                    topic[at] = near.argmax(1)
                    closeness[at] = near.max(1)
                    for i, row in zip(at, x):
                        vectors[i] = row
                yield b.assign(topic=topic, closeness=closeness, embedding=vectors)[keep]

        return fine.mapInPandas(run, schema)

    for _ in range(rounds):
        told = nearest(centres, f"period {period}, topic int, embedding array<double>", ["period", "topic", "embedding"])
        moved = {p: c.copy() for p, c in centres.items()}
        for r in V.mean_vector(told, ["period", "topic"], "embedding", "mean").collect():  # k rows a period
            mean = np.array(r["mean"])
            if np.linalg.norm(mean) > 1e-12:
                moved[r["period"]][r["topic"]] = unit(mean)
        still = all(np.abs(moved[p] - centres[p]).max() < 1e-9 for p in centres)
        centres = moved
        if still:
            break

    kind = dict(rows.dtypes)["id"]
    told = save(nearest(centres, f"period {period}, id {kind}, topic int, closeness double", ["period", "id", "topic", "closeness"]), "nearest")
    told = told.withColumn("topic", F.when(F.col("closeness") >= least_closeness, F.col("topic")).otherwise(-1))
    few = told.groupBy("period", "topic").agg(F.count("*").alias("n")).filter((F.col("topic") >= 0) & (F.col("n") < least_size)).select(F.col("period").alias("__p"), F.col("topic").alias("__t"), F.lit(True).alias("few"))
    met = told.join(few, told["period"].eqNullSafe(few["__p"]) & (told["topic"] == few["__t"]), "left")
    out = met.select("period", "id", F.when(F.col("few"), -1).otherwise(F.col("topic")).alias("topic"), "closeness")
    return out.unionByName(rows.filter("embedding is null").select("period", "id", F.lit(-1).alias("topic"), F.lit(None).cast("double").alias("closeness")))
