"""Cleaning, splitting and filtering documents (document_id, text, ts, url, source, title)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.written import save

#: Marks of texts that aren't articles, and hosts whose pages aren't wanted.
BAD_MARKS = ("[if", "javascript", "cookie", "subscribe to read")
BLACKLIST = ("src3.example.com", "src7.example.com")
#: Frequent short words of each language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "on", "was", "with", "as", "be", "this", "by", "are", "from", "it", "at", "which"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "est", "sur", "pas", "au", "avec", "par"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "que", "en", "un", "una", "con", "por", "para", "se", "es", "lo", "su", "como", "al"],
}


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are one key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def number_in_order(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Consecutive numbers from 0 in a total order without sorting in one task.

    Rows are range-partitioned, written with their partition's number and counted by it; each partition's rows are numbered from its
    offset. The counts, one for each partition, are all that meets in one place.
    """
    df = save(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "in_order")
    sized = df.groupBy("__p").agg(F.count("*").alias("__c"))
    offsets = sized.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return df.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__before") + F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1).drop("__p", "__before")


def clean_documents(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """Drop rows without text or time, keep the first of equal (ts, text), number in time order, derive the source, keep the
    first of each title. Numbers are given before titles are deduplicated, so they have gaps. Texts are compared by a digest and
    needn't travel on."""
    rows = df.filter(F.col("text").isNotNull() & F.col("ts").isNotNull()).withColumn("__digest", F.sha2("text", 256))
    rows = first_per_key(rows if keep_text else rows.drop("text"), ["ts", "__digest"], ["document_id"]).drop("__digest")
    rows = number_in_order(rows, ["ts", "document_id"]).withColumn("source", T.source_from_url(F.col("url")))
    return first_per_key(rows, ["title"], ["number"])


def split_paragraphs(df: DataFrame, min_chars: int) -> DataFrame:
    """A row for each paragraph: texts split at blank lines or, having none, at line ends; short and blank ones go."""
    parts = F.split("text", "\n\n")
    parts = F.when(F.size(parts) == 1, F.split("text", "\n")).otherwise(parts)
    rows = df.withColumn("__parts", parts).select(*[c for c in df.columns if c != "text"], F.posexplode("__parts").alias("pos", "text"))
    return rows.filter((F.length("text") >= min_chars) & F.col("text").rlike(r"\S"))


#: White space of the splitter: tab to carriage return, and the blank.
BLANKS = " \t\n\x0b\x0c\r"


def blank_words(text: str) -> int:
    """How many runs of other characters white space leaves."""
    parts = text.translate(dict.fromkeys(map(ord, BLANKS), " ")).split(" ")
    return len(parts) - parts.count("")


def budget_splitter(count: Callable[[str], int] = blank_words):
    """A table function (text, budget) -> pos, piece for LATERAL joins, in SQL after ``spark.udtf.register``.

    Sentences of a paragraph are packed while their tokens stay within the budget; a sentence over it ends the piece and is cut by characters, in
    proportion to its tokens, until the rest fits. ``count`` tells the tokens of a text. Pieces are numbered from 0; a null text has none.
    """
    import re

    blank = "[\t-\r ]"

    class Pieces:
        def eval(self, text: str, budget: int):
            pos = 0
            for paragraph in re.split("\n+", text or ""):
                for piece in self.packed(paragraph.strip(BLANKS), budget):
                    if piece:
                        yield pos, piece
                        pos += 1

        def packed(self, paragraph: str, budget: int):
            held, used = [], 0
            for sentence in re.split(f"(?<=[.!?]){blank}+", paragraph):
                n = count(sentence)
                while n > budget:
                    at = max(1, len(sentence) * budget // n)
                    yield " ".join(held)
                    yield sentence[:at].strip(BLANKS)
                    held, used, sentence = [], 0, sentence[at:].strip(BLANKS)
                    n = count(sentence)
                if held and used + n > budget:
                    yield " ".join(held)
                    held, used = [], 0
                if sentence:
                    held.append(sentence)
                    used += n
            yield " ".join(held)

    return F.udtf(Pieces, returnType="pos int, piece string", useArrow=True)


def split_sentences_budget(df: DataFrame, budget: int, count: Callable[[str], int] = blank_words) -> DataFrame:
    """The other columns of each row with pos and text of the pieces of its text (see ``budget_splitter``)."""
    rest = [c for c in df.columns if c != "text"]
    return df.lateralJoin(budget_splitter(count)(F.col("text").outer(), F.lit(budget))).select(*rest, "pos", F.col("piece").alias("text"))


def cutoff_recent(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last days before the newest row."""
    newest = df.agg(F.max(ts).alias("__newest"))
    return df.crossJoin(F.broadcast(newest)).filter(F.col(ts) >= F.col("__newest") - F.make_dt_interval(F.lit(days))).drop("__newest")


def dedupe_url_priority(df: DataFrame, priority: Column, pos: str) -> DataFrame:
    """First row of each url by priority, then position; rows without url go; summary is the text's beginning."""
    rows = df.filter(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("priority", priority)
    return first_per_key(rows, ["url"], ["priority", pos]).withColumn("summary", F.substring("text", 1, 200))


def blacklist_filter(df: DataFrame, hosts: tuple[str, ...] = BLACKLIST) -> DataFrame:
    wanted = "|".join(h.replace(".", r"\.") for h in hosts)
    return df.filter(~F.coalesce(F.col("url").rlike(wanted), F.lit(False)))


def bad_text_filter(df: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for mark in BAD_MARKS:
        bad = bad | F.contains(F.lower("text"), F.lit(mark))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def language_votes(df: DataFrame, key: str) -> DataFrame:
    """key and the language whose stop words a text holds most often (ties: first by name)."""
    spark = df.sparkSession
    stop = spark.createDataFrame([(lang, w) for lang, own in STOP_WORDS.items() for w in own], "language string, word string")
    tokens = df.select(key, F.explode(T.words(F.col("text"))).alias("word"))
    votes = tokens.join(F.broadcast(stop), "word").groupBy(key, "language").agg(F.count("*").alias("votes"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("v"), "language"))["language"].alias("detected"), F.max("votes").alias("votes"))


def html_to_text(df: DataFrame, longest: int | None = None) -> DataFrame:
    """Title and text of pages by removing code and tags; whole texts, or cut at ``longest``."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</(script|style|head)>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"[\s]+", " ")
    return df.withColumn("title", title).withColumn("text", F.trim(text) if longest is None else F.substring(F.trim(text), 1, longest))


def sample_by_hash(df: DataFrame, key: str, percent: int) -> DataFrame:
    """A sample that any engine draws alike: rows whose key's digest falls under the share."""
    return df.filter(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent)
