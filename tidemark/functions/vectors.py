"""Vectors in array columns: products, norms, cosine, means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """The mean of the vectors of each key, dimension by dimension; ``n`` counts the vectors.

    Each task adds up its own vectors as wholes, so a row for each key (and length) and task is shuffled. A vector with null components, which
    aren't counted, has them as zeros and is twice as long: its second half marks them. Null and empty vectors don't count. There is one aggregation and no union of
    two: a union of sides that are dealt by the keys counts as dealt by them, and a later join fails where its parts come out as another number.
    """
    gaps = F.exists("__v", lambda x: x.isNull())
    filled, marks = F.transform("__v", lambda x: F.coalesce(x, F.lit(0.0))), F.transform("__v", lambda x: x.isNull().cast("double"))
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("__v")).filter(F.size("__v") > 0)
    rows = rows.select(*keys, F.size("__v").alias("__d"), F.when(gaps, F.concat(filled, marks)).otherwise(F.col("__v")).alias("__v"))
    whole = rows.groupBy(*keys, "__d", F.size("__v").alias("__l")).agg(Summarizer.sum(array_to_vector("__v")).alias("__s"), F.count("*").alias("n"))
    told = whole.select(*keys, "__d", "n", vector_to_array("__s").alias("__s")).withColumn("__m", F.slice("__s", F.col("__d") + 1, F.col("__d")))
    sums = told.select(*keys, "n", "__m", F.posexplode(F.slice("__s", F.lit(1), F.col("__d"))).alias("__i", "__x"))
    by_place = sums.groupBy(*keys, "__i").agg(F.try_divide(F.sum("__x"), F.sum(F.col("n") - F.coalesce(F.get("__m", F.col("__i")), F.lit(0.0)))).alias("__m"), F.sum("n").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"])
    return by_place.groupBy(*keys).agg(F.max("n").alias("n"), ordered.alias(out))
