"""Language ID: held-out accuracy, scripts beside each other, whole texts."""

import random

from pyspark.sql import functions as F

from tidemark.llm import language_id

SCHEMA = "doc_id long, text string, lang string"
SCRIPTS = {"aa": "abcdefghijklmnop", "bb": "αβγδεζηθικλμν", "cc": "абвгдежзиклмноп", "dd": "abcdefghijklmñoß", "ee": "일이삼사오육칠팔구십", "ff": "一二三四五六七八九十百千"}


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    got = language_id.identify(docs, language_id.fit(docs), "lang").filter(language_id.fold(F.col("doc_id")) == 0).filter("lang is not null and lang_pred != 'und'").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)


def test_many_scripts_and_rare_letters(spark):
    """More letters than any fixed alphabet held; aa and dd differ by two of sixteen letters."""
    r = random.Random(3)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(30))
    wide = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(i, text(SCRIPTS[lang] if lang != "gg" else wide), lang) for i in range(700) for lang in [[*SCRIPTS, "gg"][i % 7]]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(df, language_id.fit(df)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)


def test_whole_texts_are_learned_and_read(spark):
    """What tells the languages apart begins behind 5000 characters that both share; ids repeat and may be null."""
    head = "lorem ipsum dolor " * 300
    rows = [(i, head + ("zub zob zab " if i % 2 else "kit ket kat ") * 40, "ab"[i % 2]) for i in range(60)] * 2
    rows += [(None, head + "zub zob " * 30, "a"), (7, None, "a"), (7, "zub " * 9, "b"), (900, "zub zob zab " * 20_000, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("k", F.lit(1))
    got = language_id.identify(df, language_id.fit(df)).collect()
    assert len(got) == len(rows)
    assert all(x["lang_pred"] == "ab"[x["doc_id"] % 2] for x in got if x["doc_id"] is not None and x["doc_id"] < 60 and x["lang_pred"] != "und")
    assert {x["lang_pred"] for x in got if x["doc_id"] in (None, 900)} == {"b"}
