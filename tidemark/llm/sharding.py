"""Operator 4: shards by vector bin packing over bytes, tokens and rows.

Documents with equal texts are a group, and a group that fits into a shard lies in one shard. Groups are placed from the largest on, each
into the shard whose residual capacity has the highest dot product with its vector of bytes, tokens and rows in shares of the totals; shards
without room for its bytes come last (then the emptiest is taken). Groups above a small share of a shard, of which there can only be a fixed
number, are placed one by one; the others are gathered by hash into atoms, a fixed number for any input, and an atom is placed as a whole. A large group is counted
and numbered in parts by the hash of doc_id (by place in the input, where one doc_id alone is too large); its parts are placed one by one where no
shard has room for the whole. Only the sums of atoms and parts, bounded in number, are seen by the driver. The law is ``bytes``: the shards' sizes are near equal.

A row's slot is its atom's (or part's) offset in the shard plus its place there, so no shard is sorted as a whole.

Edge cases: a null text has no bytes (size 16, the CRC of nothing); rows without doc_id and repeated rows get slots of their own; with fewer rows
than shards some shards stay empty; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Atoms a shard has on average, and parts of a shard that a group of equal texts may fill before it is placed by itself.
ATOMS, PARTS = 128, 64


def pack(weights: np.ndarray, shards: int, groups: np.ndarray | None = None) -> np.ndarray:
    """Shard of each row of ``weights`` (bytes, tokens, rows), greedily by the dot product with residual capacity.

    Rows with the same number in ``groups`` (below 0: none) go together, unless no shard has room for them.
    """
    total = np.maximum(weights.sum(0), 1)
    share = weights / total * shards  # capacity of a shard: 1 in each dimension
    free = np.ones((shards, weights.shape[1]))
    out = np.zeros(len(weights), np.int64)
    groups = np.full(len(weights), -1) if groups is None else groups
    together = {g: np.flatnonzero(groups == g) for g in np.unique(groups[groups >= 0])}
    waiting = [(-share[at].sum(0)[0], -share[at].sum(), i, at) for i, at in enumerate([[i] for i in np.flatnonzero(groups < 0)] + list(together.values()))]
    heapq.heapify(waiting)
    while waiting:
        _, _, i, at = heapq.heappop(waiting)
        own = share[at].sum(0)
        # while a shard has room for the bytes, those without stay behind; then the emptiest takes them
        room = free[:, 0] >= own[0]
        if not room.any() and len(at) > 1:
            for j in at:
                heapq.heappush(waiting, (-share[j, 0], -share[j].sum(), len(weights) + int(j), [j]))
            continue
        best = int(np.argmax(np.where(room, free @ own, -np.inf))) if room.any() else int(np.argmax(free[:, 0]))
        out[at] = best
        free[best] -= own
    return out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = saved(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                             F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.xxhash64(text).alias("g"), F.monotonically_increasing_id().alias("at")), "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    part = max(1, total // (shards * PARTS))  # so at most shards * PARTS groups are larger
    heavy = rows.groupBy("g").agg(F.sum("size").alias("b")).filter(F.col("b") > part).select(F.col("g").alias("heavy"), F.ceil(F.col("b") / part).alias("k"))
    # at most as many ids, null among them, hold so much of one text
    single = rows.groupBy("g", "doc_id").agg(F.sum("size").alias("b")).filter(F.col("b") > part).select(F.col("g").alias("one_g"), F.col("doc_id").alias("one_id"), F.lit(True).alias("one"))
    atoms = shards * ATOMS
    salted = rows.join(F.broadcast(heavy), rows["g"] == F.col("heavy"), "left").join(F.broadcast(single), (rows["g"] == F.col("one_g")) & rows["doc_id"].eqNullSafe(F.col("one_id")), "left")
    spread = F.pmod(F.when(F.col("one"), F.xxhash64("at")).otherwise(F.xxhash64("doc_id", "g")), F.col("k"))
    large = F.col("k").isNotNull()
    placed = salted.withColumn("atom", F.when(large, F.col("g")).otherwise(F.pmod(F.xxhash64("g", F.lit(1)), F.lit(atoms)))).withColumn("part", F.when(large, spread).otherwise(-1)).drop("g", "k", "heavy", "one_g", "one_id", "one", "at")
    sums = placed.groupBy("atom", "part").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("part", "atom").toPandas()
    if len(sums):
        groups = np.where(sums["part"] < 0, -1, pd.factorize(sums["atom"])[0])
        sums["shard"] = pack(sums[["b", "t", "n"]].to_numpy(float), shards, groups).astype(np.int32)
        sums["offset"] = sums.groupby("shard")["n"].cumsum() - sums["n"]
    else:
        sums["shard"], sums["offset"] = sums["atom"].astype(np.int32), sums["atom"]
    where = docs.sparkSession.createDataFrame(sums[["atom", "part", "shard", "offset"]], "atom long, part long, shard int, offset long")
    place = F.row_number().over(Window.partitionBy("atom", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.join(F.broadcast(where), ["atom", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + place - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
