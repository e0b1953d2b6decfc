"""What the given tables stand for: a stream of documents, topics with vectors, an activity stream.

documents: one row a document, a time stamp from doc_id, url from source and language, the first line as title.
embeddings: a document's vector on vec_id = doc_id; its label is its topic, label 9 the outliers (-1).
events: topic = user_id % 10, source = event_type, each event one document. Where topics are to fall idle, one is what a user does of
one kind (``kinds``), about ten events in a month.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = 7
#: The given vectors are nearly random, so topics are matched at a low cosine here (the operators' default is 0.7).
SIMILARITY = 0.1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id * 7 % 720 as int))")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", ts.alias("ts"), url.alias("url"), "source", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))


DOCS = """docs AS (SELECT doc_id AS document_id, text, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 720 AS INTEGER)) AS ts,
  concat('https://', source, '.example.com/', lang, '/', doc_id) AS url, source, lang, split_part(text, chr(10), 1) AS title FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, topic, embedding, period, ts, source, url, lang of the documents that have a vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int").alias("topic"), "embedding")
    day = F.to_date("ts")
    rows = documents(spark, sf_dir).select("document_id", "ts", "source", "url", "lang", "title")
    return v.join(rows, "document_id").withColumn("period", F.date_sub(day, F.pmod(F.datediff(day, F.lit("2024-01-01").cast("date")), F.lit(DAYS))))


VECTORS = f"""{DOCS}, vecs AS (SELECT v.vec_id AS document_id, CAST(CASE WHEN v.label = 9 THEN -1 ELSE v.label END AS INTEGER) AS topic,
  CAST(v.embedding AS DOUBLE[]) AS embedding, d.ts, d.source, d.url, d.lang, d.title,
  CAST(CAST(d.ts AS DATE) - CAST((CAST(d.ts AS DATE) - DATE '2024-01-01') % {DAYS} AS INTEGER) AS DATE) AS period
  FROM embeddings v JOIN docs d ON v.vec_id = d.document_id)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, topic, source, ts, day of the events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), (F.col("user_id") % 10).alias("topic"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ntz").alias("ts")).withColumn("day", F.to_date("ts"))


ACTIVITY = "acts AS (SELECT event_id AS document_id, user_id % 10 AS topic, event_type AS source, ts, CAST(ts AS DATE) AS day FROM events)"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity with a topic for each user and kind of event, told by the kind's digest."""
    e = table(spark, sf_dir, "events")
    topic = F.col("user_id") * 1000 + F.conv(F.substring(F.md5(F.col("event_type").cast("binary")), 1, 4), 16, 10).cast("long") % 1000
    return e.select(F.col("event_id").alias("document_id"), topic.alias("topic"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ntz").alias("ts")).withColumn("day", F.to_date("ts"))


KINDS = "kinds AS (SELECT event_id AS document_id, user_id * 1000 + CAST(concat('0x', left(md5(event_type), 4)) AS BIGINT) % 1000 AS topic, event_type AS source, ts, CAST(ts AS DATE) AS day FROM events)"
