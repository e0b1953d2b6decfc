"""Operator 11: how filters interact, by a Gray-code walk over their subsets.

Each document gets a mask of the filters it fails. Documents of one part and mask are one cell with three counts (documents,
good ones, toxic ones), so a part has at most 2**n cells, made with map-side sums. For each part a Gray-code walk toggles one
filter at a time: every cell that fails it counts one active failure more or less, and where that count leaves or reaches
zero the cell's counts leave or join the running survivors. The survivors of all 2**n subsets are kept; every step of every
order of the filters is the difference of two of them.

The query's filters: A under 200 words, B fewer than half of the words distinct, C more than 2 % capitals A-Z, D one of
``#$%&*|``, E the same text as a row of smaller doc_id, in the whole table.

Edge cases: a null text is empty (it fails A alone, and E if an empty text comes before); null sources are the part ''; a row without
doc_id is never a repeat of another, and has no label; rows that repeat one doc_id with one text aren't repeats of each other; a document is
good (toxic) if any of its label rows says so; further columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, saved

#: Words end at these characters alone.
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """When a text fails the filters that look at nothing but itself; ``words`` are its words in order."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails the i-th filter of ABCDE), good, toxic of each document."""
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    told = told.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = text_failures(F.col("text"), F.col("words"))
    mask = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values()))
    rows = saved(told.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    # texts that occur once have nothing before them
    first = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    rows = attach(rows, first, ["digest"], "n", rows.count())
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "part", (F.col("mask") + F.when(repeat, 1 << len(fails)).otherwise(0)).alias("mask"),
                       # rows without id meet no label; they are dealt out by their text
                       F.when(F.col("doc_id").isNull(), F.xxhash64("digest", F.monotonically_increasing_id())).otherwise(0).alias("salt"))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))))
    said = said.withColumn("label_salt", F.lit(0).cast("long"))
    met = rows.join(said, (rows["doc_id"] == said["label_id"]) & (rows["salt"] == said["label_salt"]), "left")
    return met.select("part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def survivors(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """What is left of the weights (a row a cell) under each subset of filters, by toggling one filter at a time."""
    failing = np.zeros(len(masks), np.int64)
    left, subset = weights.sum(0), 0
    states = np.zeros((1 << filters, weights.shape[1]), np.int64)
    states[0] = left
    for i in range(1, 1 << filters):
        bit = i & -i  # the place of the lowest set bit is what a Gray code toggles next
        subset ^= bit
        hit = (masks & bit) != 0
        if subset & bit:
            left = left - weights[hit & (failing == 0)].sum(0)
            failing += hit
        else:
            failing -= hit
            left = left + weights[hit & (failing == 0)].sum(0)
        states[subset] = left
    return states


def audit(rows: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of each step, for every part and order; ``rows`` has part, mask, good, toxic."""
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        masks, weights = own["mask"].to_numpy(np.int64), own[["n", "good", "toxic"]].to_numpy(np.int64)
        states = survivors(masks, weights, len(letters))
        bits = {c: 1 << i for i, c in enumerate(letters)}
        failing = {c: int(weights[(masks & b) != 0, 0].sum()) for c, b in bits.items()}
        alone = {c: int(weights[masks == b, 0].sum()) for c, b in bits.items()}
        removed_in_all, out = dict.fromkeys(letters, 0), []
        for order in permutations(letters):
            before = 0
            for step, c in enumerate(order, 1):
                after = before | bits[c]
                gone = states[before] - states[after]
                removed_in_all[c] += int(gone[0])
                out.append(("".join(order), step, states[after][0], gone[0], failing[c] - gone[0], alone[c], gone[1], gone[2]))
                before = after
        told = pd.DataFrame(out, columns=["filter_order", "step", *COUNTS[:-1]])
        told["shapley"] = [removed_in_all[o[s - 1]] for o, s in zip(told["filter_order"], told["step"])]
        return told.assign(part=own["part"].iloc[0])[["part", "filter_order", "step", *COUNTS]]

    return cells.groupBy("part").applyInPandas(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
