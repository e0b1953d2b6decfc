"""Each stage on null ids, repeated rows, empty tables and columns whose names operators use inside."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import bpe, language_id, ngram_join, token_counts, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A farmer named Otto sells 14 crates of yellow pears to the market every Monday"


def english(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice("the of and river mountain bread winter carries under every garden little with stone evening water house road bird field".split()) for _ in range(n))


def table(rows):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    near = english(900, 60)
    rows = [(i, english(i)) for i in range(1, 61)]
    rows += [(100, near), (101, near + " ending"), (None, near + " other"), (None, "x " + english(901, 60)), (None, "y " + english(901, 60)), (None, "y " + english(901, 60)), (5, english(5))]
    rows += [(200, english(60, 12) + " " + ITEM.replace("Otto", "Karl").replace("14", "90") + " " + english(61, 12)), (None, english(62, 12) + " " + ITEM + " " + english(63, 12)), (201, None), (202, ""), (203, "12 %% 34"), (2**60 + 1, "write to me@corp.org " + english(64))]
    spark.createDataFrame(table(rows), SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_decide_on_rows_without_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(1) for c in ("h", "cid", "component", "cut", "base", "rejected")})
    known = P.keep_known_languages(spark, docs, folder)
    assert known.columns == P.COLUMNS
    kept = sorted(((r["doc_id"], r["text"]) for r in known.collect()), key=str)
    assert not {201, 202, 203} & {i for i, _ in kept} and len(kept) == docs.count() - 3
    single = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, known, folder).collect()), key=str)
    assert sum(t.startswith(english(900, 60)) for _, t in single) == 1 and (100, english(900, 60)) in single
    assert sum(t.endswith(english(901, 60)) for _, t in single) == 1 and sum(i == 5 for i, _ in single) == 1 and len(single) == len(kept) - 5
    clean = P.drop_contaminated(spark, docs, folder)
    assert not any(t and "crates of yellow pears" in t for t in (r["text"] for r in clean.collect())) and clean.count() == docs.count() - 2
    safe = {r["doc_id"]: r for r in P.remove_personal_data(spark, docs, folder).collect()}
    assert safe[2**60 + 1]["text"].startswith("write to [EMAIL] ") and safe[2**60 + 1]["n_chars"] == len(safe[2**60 + 1]["text"]) and safe[7]["text"] == english(7)
    assert P.encode(spark, docs, folder).count() == docs.count()


def test_run_equals_its_stages(spark, folder):
    out = P.run(spark, folder).collect()
    assert len(out) == 60 + 3 and 2**60 + 1 in {r["doc_id"] for r in out} and all(len(r["ids"]) == r["n_tokens"] > 0 for r in out)


def test_empty_tables(spark, folder, tmp_path):
    at = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{at}/benchmark.parquet")
    assert P.run(spark, at).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert P.drop_contaminated(spark, docs, at).count() == docs.count()


def test_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**62 + 3]
    docs = spark.createDataFrame([(i, english(k)) for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    of = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    for df in (bpe.encode_documents(docs, registry.tokenizer_path("word_bpe_49k.json")), token_counts.count_tokens(docs, registry.tokenizer_path("piece_bpe_32k.model")),
               ngram_join.near_duplicates(docs), language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit("en"))))):
        assert of(df) == sorted(ids, key=str)
