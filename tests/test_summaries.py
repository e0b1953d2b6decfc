"""Summaries and phrase matches of whole documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import summaries as M
from tidemark.plans import reports


def test_factored_ranks_equal_the_matrix():
    r = np.random.default_rng(2)
    x = r.integers(0, 3, (60, 12)).astype(float)
    x[:20, 6:], x[20:, :6], x[7] = 0, 0, 0  # two components and a row without a word
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert M.factored_lexrank(x) == pytest.approx(M.lexrank(x @ x.T), abs=1e-12)


def test_vectors_equal_the_expression(spark):
    df = spark.createDataFrame([("Two  words İN a été.",), ("",), ("x",)], "sentence string")
    for letters, by in ((False, " "), (True, "")):
        both = df.select(M.sentence_vectors(F.col("sentence"), 16, letters).alias("a"), M.hashed_vector(F.split(F.lower("sentence"), by), 16).alias("b"))
        assert all(r["a"] == r["b"] for r in both.filter("sentence != ''" if letters else "true").collect())


def long_documents(spark, path):
    """The telling sentences and the well spelt phrase stand behind the first 3000 characters."""
    odd = [" ".join(f"{w}{k}" for w in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op")) + "." for k in range(150)]
    telling = ["River water flows to the sea.", "The river water flows to the sea.", "To the sea flows the river water."] * 4
    text = " ".join(odd + telling) + " Then ef0 ab0 gh0x again."
    spark.createDataFrame([(2, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return text


def test_queries_read_whole_documents(spark, tmp_path):
    text = long_documents(spark, tmp_path)
    assert any("river water" in r["sentence"].lower() for r in reports.lexrank_summary(spark, str(tmp_path)).collect())
    assert max(r["pos"] for r in reports.chunk_summary(spark, str(tmp_path)).collect()) > 3000 // 45 // 5
    sentences = M.split_sentences(reports.documents(spark, str(tmp_path)), "document_id").orderBy("pos")
    unit = lambda by, dim: np.array([r[0] for r in sentences.select(M.hashed_vector(F.split(F.lower("sentence"), by), dim), "pos").collect()])
    graph = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    weights = M.lexrank(0.5 * graph(unit(" ", M.DIM)) + 0.5 * graph(unit("", 32)))
    best = np.sort(np.argsort(-np.round(weights, 12), kind="stable")[:3]).tolist()
    assert sorted(r["pos"] for r in reports.lexrank_blend(spark, str(tmp_path)).collect()) == best
    s = reports._sentences(spark, str(tmp_path)).collect()
    assert sum(len(r["sentence"]) + 1 for r in s) == len(text) + 1


def test_phrase_is_found_behind_the_first_words(spark, tmp_path):
    text = "one two three four five six " + "filler word " * 300 + "three four fivex end"
    spark.createDataFrame([(2, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = reports.phrase_match_embedding(spark, str(tmp_path)).collect()
    assert [(r["window"], r["score"]) for r in got] == [("three four fivex", 100.0)]


def test_sentences_keep_the_digits_of_their_place(spark):
    """The second sentence lost the 1s at its ends, the third its 2s; of three underscores the last two were the mark."""
    df = spark.createDataFrame([(1, "0 at 0. 148.9 is 1. 2 and 2"), (2, "a.  b! __ c? d___e. f\x0bg.\x0bh"), (3, ""), (4, None)], "k long, text string")
    assert [tuple(r) for r in M.split_sentences(df, "k").orderBy("k", "pos").collect()] == [
        (1, 0, "0 at 0."), (1, 1, "148.9 is 1."), (1, 2, "2 and 2"), (2, 0, "_e."), (2, 1, "f\x0bg.\x0bh")]


def test_reordered_sentences_see_the_digits_of_their_place(spark):
    df = spark.createDataFrame([(1, "A. 11 b."), (2, "B 11.")], "k long, text string")
    assert {tuple(r) for r in M.word_set_duplicates(M.split_sentences(df, "k"), "k").collect()} == {(1, 1, "1:1", 1), (2, 0, "1:1", 1)}


def test_documents_are_ranked_where_their_rows_stay(spark, monkeypatch):
    """Neither sentences nor vectors are shuffled; long documents, repeated ids and empty texts are ranked as the others are."""
    r = np.random.default_rng(5)
    texts = [" ".join(" ".join(f"W{w}É" for w in r.integers(0, 30, r.integers(1, 9))) + "." for _ in range(n)) for n in (0, 1, 4, 30, 30, 3)]
    rows = [*enumerate(texts), (7, None), (None, texts[2])]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("sentences", M.sentences_of(F.col("text")))
    got = M.summarise(df, "k", 5, 0.5, [(0.5, 64, False), (0.5, 32, True)])
    assert "Exchange" not in got._jdf.queryExecution().toString()
    apart = M.split_sentences(df, "k").withColumns({"embedding": M.sentence_vectors(F.col("sentence")), "letters": M.sentence_vectors(F.col("sentence"), 32, True)})
    wanted = sorted(map(str, M.lexrank_summary(apart, "k", 5, 0.5, "letters").collect()))
    assert sorted(map(str, got.collect())) == wanted and len(wanted) > 15
    monkeypatch.setattr(M, "LONG", 10)
    assert sorted(map(str, M.summarise(df, "k", 5, 0.5, [(0.5, 64, False), (0.5, 32, True)]).collect())) == wanted
    again = df.filter("k = 3").union(df.filter("k = 3"))
    assert M.summarise(again, "k").count() == 2 * M.summarise(df.filter("k = 3"), "k").count() == 6


def test_pieces_of_words_stay_with_their_row(spark, tmp_path):
    """The pieces of a text aren't shuffled by its id; words of more than a piece, several blanks and a text without words."""
    texts = [(1, " abcdef  g\n\nhi"), (2, "\t"), (3, "abcd é")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = reports.group_subword_tokens(spark, str(tmp_path))
    assert "Window" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 3, 9, 2.0), (3, 1, 6, 3.5)]
