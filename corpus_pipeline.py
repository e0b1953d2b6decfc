"""From raw documents to token ids: language ID, near-duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language_id, ngram_join, pii, registry
from tidemark.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Documents whose id (null too) and text hash are among ``keys`` (doc_id, h), or aren't."""
    keys = keys.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("__own"))
    return keyed.join(keys, keyed["doc_id"].eqNullSafe(keys["__id"]) & (keyed["__own"] == keys["__h"]), how).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language models reject (no letter, or unlike every learned language)."""
    keyed = docs.withColumn("h", F.xxhash64("text"))
    rejected = saved(language_id.identify(keyed, language_id.fit(docs), "h").filter("rejected").select("doc_id", "h").distinct(), "rejected")
    return with_key(docs, rejected, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document of smallest doc_id, once; one without doc_id if all are, that of
    smallest text hash. Texts without words are in no group and stay."""
    found = saved(ngram_join.near_duplicates(docs).select("doc_id", "h", "component"), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = found.filter("component is not null").groupBy("component").agg(F.min(key).alias("k")).select("k.doc_id", "k.h")
    kept = saved(first.union(found.filter("component is null").select("doc_id", "h").distinct()), "first")
    out = with_key(docs, kept, "left_semi")
    grouped = found.filter("component is not null").groupBy("component", "doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1")
    if not grouped.isEmpty():  # repeated rows
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, whatever its numbers, names and units have become."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark")).select("doc_id.doc_id", "doc_id.h").distinct()
    return with_key(docs, saved(found, "contaminated"), "left_anti")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and disclosing terms in the texts; no document goes."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text with their digest and that of what they decode to."""
    return bpe.encode_documents(docs, registry.tokenizer_path("word_bpe_49k.json"), decoded=False)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("encoding", encode),
]
#: Character models, tile joins and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
