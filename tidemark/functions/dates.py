"""Periods and date grids. Time stamps are without zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def add_days(ts: Column, n: Column | int) -> Column:
    return ts + F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def fixed_periods(df: DataFrame, days: int, ts: str = "ts", out: str = "period") -> DataFrame:
    """Add the first day of each row's period; periods of ``days`` days begin at the first day of the table."""
    first = df.agg(F.min(F.to_date(ts)).alias("__first"))
    day = F.to_date(ts)
    return df.crossJoin(F.broadcast(first)).withColumn(out, F.date_sub(day, F.pmod(F.datediff(day, "__first"), F.lit(days)))).drop("__first")


def grouped_timestamps(df: DataFrame, days: float, ts: str = "ts", out: str = "period") -> DataFrame:
    """Add the time stamp floored to ``days`` days counted from the smallest time stamp itself."""
    step = int(days * DAY_US)
    first = df.agg(F.min(ts).alias("__first"))
    whole = F.floor((micros(F.col(ts)) - micros(F.col("__first"))) / step)
    return df.crossJoin(F.broadcast(first)).withColumn(out, F.col("__first") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole * (step / 1_000_000)).cast("decimal(18,6)"))).drop("__first")


def date_ranges(spark: SparkSession, start: Column, end: Column, n: int, df: DataFrame | None = None) -> DataFrame:
    """Consecutive ranges of n days from start to end, the last one maybe shorter: range_start, range_end."""
    base = df if df is not None else spark.range(1)
    step = F.expr(f"interval {n} days")
    last = F.when(start + step > end, start).otherwise(F.date_sub(end, 1))
    return base.withColumn("range_start", F.explode(F.sequence(start, F.greatest(start, last), step))).withColumn("range_end", F.least(F.date_add("range_start", n), end))


#: The widths that documents are counted by, as number and unit: days, weeks, months, years.
FREQUENCIES = ("1D", "2D", "1W", "2W", "1M", "2M", "1Y", "2Y")


def _unit(day: Column, unit: str) -> Column:
    """Number of the week (Monday to Sunday), month or year that holds a day."""
    return {"W": F.floor((F.unix_date(day) + 3) / 7), "M": F.year(day) * 12 + F.month(day) - 1, "Y": F.year(day)}[unit].cast("int")


def _unit_end(n: Column, unit: str) -> Column:
    ends = {"W": lambda: F.date_from_unix_date(n * 7 + 3), "M": lambda: F.last_day(F.make_date(F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1))), "Y": lambda: F.make_date(n, F.lit(12), F.lit(31))}
    return ends[unit]()


def calendar_counts(df: DataFrame, day: str, freq: str) -> DataFrame:
    """bucket, n: rows by stretches of ``freq`` (as in FREQUENCIES), empty stretches included; rows without a day are left out.

    Stretches of days begin with the first day and are named by their first one. Those of weeks, months and years are named by their last day, and the
    first one ends with the unit that holds the first day.
    """
    width, unit = int(freq[:-1]), freq[-1]
    counts = df.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    place = F.unix_date("day") if unit == "D" else _unit(F.col("day"), unit)
    placed = counts.select(place.alias("u"), "n").groupBy("u").agg(F.sum("n").alias("n"))
    first = placed.agg(F.min("u").alias("u0"), F.max("u").alias("u1"))
    step = F.floor if unit == "D" else F.ceil
    at = (F.col("u0") + step((F.col("u") - F.col("u0")) / width) * width).cast("int")
    told = placed.crossJoin(F.broadcast(first)).groupBy(at.alias("at")).agg(F.sum("n").alias("n"))
    spine = first.filter("u0 is not null").select(F.explode(F.sequence("u0", (F.col("u0") + step((F.col("u1") - F.col("u0")) / width) * width).cast("int"), F.lit(width))).alias("at"))
    name = F.date_from_unix_date("at") if unit == "D" else _unit_end(F.col("at"), unit)
    return spine.join(told, "at", "left").select(name.alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))
