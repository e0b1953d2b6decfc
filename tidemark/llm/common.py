"""What the operators of this folder share: table access, written intermediates, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so that at most this many keys are hot.
HOT_KEYS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode alone, one of our own where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The table, after telling the session to hand Python batches of few rows and bytes, so that long texts fit.

    The two settings stay as they are when a lazy table runs, so they can't be given back; they change no result.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def as_text(name: str) -> Column:
    """An id column for Python, where whole numbers beside nulls would turn into floats."""
    return F.col(name).cast("string").alias(name)


def leaving_memory(step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The step of a mapInPandas; after its last batch the worker, which later tasks use again, returns freed memory to
    the system instead of holding it beside the next stage's."""
    @functools.wraps(step)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from step(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
        if trim:
            trim(0)

    return run


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``values`` (one row a key, ``count`` holds how many of the ``total`` rows have it).

    Keys with at least total/HOT_KEYS rows are HOT_KEYS at most, whatever the data: they travel by broadcast and
    their rows stay where they are. The rest is an ordinary equi-join without a hot key. Null keys match each other.
    """
    hot = values.filter(F.col(count) * HOT_KEYS >= F.lit(total)).drop(count)
    names = [f"__k{i}" for i in range(len(keys))]

    def renamed(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(dict(zip(keys, names)))

    def on(left: DataFrame, right: DataFrame):
        cond = F.lit(True)
        for k, n in zip(keys, names):
            cond = cond & left[k].eqNullSafe(right[n])
        return cond

    small, marks = F.broadcast(renamed(hot)), F.broadcast(renamed(hot.select(*keys)))
    cold = rows.join(marks, on(rows, marks), "left_anti")
    rest = renamed(values.filter(F.col(count) * HOT_KEYS < F.lit(total)).drop(count))
    return rows.join(small, on(rows, small), "inner").drop(*names).unionByName(
        cold.join(rest, on(cold, rest), "left").drop(*names))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) by alternating large-star and small-star steps.

    Every round is written to the shared folder. Returns (node, root): each node that has an edge with the smallest
    node of its component, the root itself included. The driver sees one count and one checksum a round.
    """
    def stars(e: DataFrame, both: bool) -> DataFrame:
        if both:
            e = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        e = e.filter(F.col("b") > F.col("a")) if both else e
        met = e.join(low, e["a"] == low["u"]).select(e["a"], e["b"], "m")
        if both:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select("a", F.col("m").alias("b")).union(met.select(F.col("b").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    now = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        now = saved(stars(stars(now, True), False), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
