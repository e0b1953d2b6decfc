"""Equi-joins that stay even when a key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so there are this many hot keys at most.
HOT_KEYS = 200


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row a key and in ``count`` how many of the ``total`` rows have it.

    Rows of hot keys stay where they are and meet their values by broadcast; the others are shuffled by a key that isn't hot.
    """
    hot = F.broadcast(values.filter(F.col(count) * HOT_KEYS >= F.lit(total)))
    cold = values.filter(F.col(count) * HOT_KEYS < F.lit(total))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
