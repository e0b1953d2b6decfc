"""Reading and writing feeds: files by extension, listings, signal tables by date and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.written import save

MANDATORY = ("text", "timestamp")


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Read csv, parquet, json, jsonl (.gz too) or xlsx by extension; None for an unknown one."""
    kind = path.removesuffix(".gz").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"', inferSchema=schema is None)
    if kind == "parquet":
        return reader.parquet(path)
    if kind in ("jsonl", "json"):
        return reader.json(path, multiLine=kind == "json")
    if kind == "xlsx":
        return read_xlsx(spark, path)
    return None


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook, all cells as text; needs openpyxl on the workers."""
    import openpyxl  # noqa: F401  optional

    def sheets(batches):
        import io

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                table = pd.read_excel(io.BytesIO(content), dtype=str)
                yield pd.DataFrame({"row": table.to_dict("records")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(sheets, "row map<string,string>")


def discover_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, bytes and modified of all files below ``path`` whose name fits the glob."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
            .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))


def validate_schema(df: DataFrame, alternatives: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename alternative columns; error if text or timestamp is missing."""
    for name, others in (alternatives or {}).items():
        if name not in df.columns:
            df = df.withColumnsRenamed({o: name for o in others if o in df.columns})
    missing = [c for c in MANDATORY if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def union_feeds(parts: list[DataFrame], key: str = "title", order: list[str] | None = None) -> DataFrame:
    """All rows of the parts, columns by name, and of each key the first row."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy(*(order or both.columns))
    return both.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def latest_feed_file(df: DataFrame, delivery: str = "[^/]*$") -> DataFrame:
    """Only the rows of the most recently written file of a feed, or of all files of the same delivery: ``delivery`` is a
    pattern for the part of the path that names it."""
    rows = df.withColumn("__at", F.col("_metadata.file_modification_time")).withColumn("__file", F.regexp_extract("_metadata.file_path", delivery, 0))
    newest = rows.agg(F.max(F.struct("__at", "__file"))["__file"].alias("__file"))
    return rows.join(F.broadcast(newest), "__file", "left_semi").drop("__at", "__file")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_signals(df: DataFrame, path: str) -> None:
    """One folder for each reference_ts and category. A date that is written again is replaced, with all its categories; others stay."""
    df = save(df, "signals")
    for (date,) in df.select("reference_ts").distinct().collect():  # the few dates of a run
        own = df.filter(F.col("reference_ts") == F.lit(date)).drop("reference_ts")
        own.write.mode("overwrite").partitionBy("category").parquet(f"{path}/reference_ts={date}")


def read_signals_between(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Stored signals of the reference dates between both, by partition pruning."""
    return spark.read.parquet(path).filter(F.col("reference_ts").cast("string").between(first, last))


def list_periods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("reference_ts").distinct()
