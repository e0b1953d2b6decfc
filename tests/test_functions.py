"""Golden values for text, dates, scores and topic metrics."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text as T, vectors as V
from tidemark.operators import cleaning as C, scoring as Q, stability as B, topics as O
from tidemark.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("given, wanted", [("C'est-à-dire", "C'est à dire"), ("10.5%", "10.5 "), ("camelCase", "camel Case"), ("super²", "super2"), ("sub₂", "sub2"), ("l’eau", "l'eau"), ("ABC", "ABC")])
def test_french_text(spark, given, wanted):
    assert one(spark, T.normalise_french(F.col("t")), t=given) == wanted


@pytest.mark.parametrize("given, wanted", [("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("02/01/2024", "2024-01-02 00:00:00"), ("Tue, 2 Jan 2024 03:04:05", "2024-01-02 03:04:05"), ("soon", None)])
def test_dates_of_many_formats(spark, given, wanted):
    assert one(spark, T.parse_date(F.col("t")), t=given) == wanted


@pytest.mark.parametrize("end, n, ranges", [("2024-01-10", 3, 3), ("2024-01-11", 5, 2), ("2024-01-03", 7, 1)])
def test_date_ranges(spark, end, n, ranges):
    assert dates.date_ranges(spark, F.lit("2024-01-01").cast("date"), F.lit(end).cast("date"), n).count() == ranges


def test_urls(spark):
    df = spark.createDataFrame([("https://www.news.example.co.uk/a/b",), ("no scheme",), (None,)], "url string")
    assert [tuple(r) for r in df.select(T.website_name(F.col("url")), T.registered_domain(F.col("url")), T.source_from_url(F.col("url"))).collect()] == [("news", "example", "www.news.example.co.uk"), ("Unknown", "", None), ("Unknown", "", None)]


def test_topic_word_metrics(spark):
    words = spark.createDataFrame([(0, ["sea", "tide", "sand", "boat"]), (1, ["tide", "moon", "boat", "net"])], "topic int, words array<string>")
    assert O.unique_word_share(words, 4).first()[0] == pytest.approx(6 / 8)
    assert O.unique_word_share(words, 2).first()[0] == pytest.approx(3 / 4)
    assert O.jaccard_diversity(words, 4).first()[0] == pytest.approx(1 - 2 / 6)
    assert O.jaccard_diversity(words.limit(1), 4).first()[0] is None


def test_perfect_article(spark):
    scores = {c: F.lit(1.0) for c in Q.WEIGHTS}
    assert one(spark, Q.final_score(scores), x=1) == pytest.approx(0.1)
    assert one(spark, Q.quality_level(Q.final_score(scores)), x=1) == "POOR"


def test_overall_stability(spark):
    rows = lambda s: spark.createDataFrame([(0, "a", "b", s), (1, None, None, 0.0)], "topic int, start_ts string, end_ts string, score double")
    got = {r["topic"]: r["score"] for r in B.overall_stability(rows(0.4), rows(0.8), 0.25).collect()}
    assert got == {0: pytest.approx(0.7), 1: 0.0}
    with pytest.raises(ValueError):
        B.embedding_stability(rows(1.0), 1)


def test_cosine_of_nothing(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) is None


def test_cleaning(spark):
    rows = [(1, "x", "2024-01-01", "https://a/1", "t"), (2, "x", "2024-01-01", "https://b/1", "u"), (3, None, "2024-01-02", None, "v"), (4, "y", "2024-01-02", None, None), (5, "z", "2024-01-03", None, None)]
    df = spark.createDataFrame(rows, "document_id long, text string, ts string, url string, title string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r["number"], r["document_id"], r["source"]) for r in C.clean_documents(df).collect()) == [(0, 1, "a"), (1, 4, None)]


def test_paragraphs_and_budget(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbb\n\n   \n\ncccc"), (2, "dddd\neeee"), (3, None)], "document_id long, text string")
    assert sorted((r["document_id"], r["text"]) for r in C.split_paragraphs(df, 3).collect()) == [(1, "aaaa"), (1, "cccc"), (2, "dddd"), (2, "eeee")]
    packed = C.split_sentences_budget(spark.createDataFrame([(1, "One two. Three four. Five.")], "document_id long, text string"), 4)
    assert [r["text"] for r in packed.orderBy("pos").collect()] == ["One two. Three four.", "Five."]


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "id int, body string")
    with pytest.raises(ValueError):
        files.validate_schema(df)
    assert files.validate_schema(df.withColumn("date", F.lit(1)), {"text": ["body"], "timestamp": ["date"]}).columns == ["id", "text", "timestamp"]
    assert files.read_documents(spark, "feed.unknown") is None


def test_budget_splitter_in_sql_and_by_hand(spark):
    spark.udtf.register("pieces", C.budget_splitter())
    spark.createDataFrame([(1, "One two. Three four. Five six seven eight nine ten.\n\nEleven"), (2, None), (3, "a\x0bb c"), (4, "x" * 50_000 + " y" * 30_000)], "id long, text string").createOrReplaceTempView("texts_to_cut")
    got = {}
    for r in spark.sql("SELECT t.id, p.pos, p.piece FROM texts_to_cut t, LATERAL pieces(t.text, 4) p ORDER BY t.id, p.pos").collect():
        got.setdefault(r["id"], []).append(r["piece"])
    assert got[1] == ["One two. Three four.", "Five six seven eight", "nine ten.", "Eleven"] and got[3] == ["a\x0bb c"] and 2 not in got
    assert "".join(got[4]).replace(" ", "") == "x" * 50_000 + "y" * 30_000 and all(C.blank_words(p) <= 4 for p in got[4])


@pytest.mark.parametrize("freq", ["1D", "2D", "1W", "2W", "1M", "2M", "1Y", "2Y"])
def test_calendar_counts_equal_pandas(spark, freq):
    import datetime as dt
    import random

    import pandas as pd

    from tidemark.functions import dates

    r = random.Random(freq)
    days = [dt.date(2021, 11, 7) + dt.timedelta(days=r.choice([0, 0, 7, r.randrange(1200)])) for _ in range(60)] + [dt.date(2021, 11, 7)]
    wanted = pd.DataFrame({"t": pd.to_datetime(days)}).groupby(pd.Grouper(key="t", freq=freq.replace("M", "ME").replace("Y", "YE"))).size()
    got = dates.calendar_counts(spark.createDataFrame([(d,) for d in [*days, None]], "day date"), "day", freq).orderBy("bucket").collect()
    assert [(r["bucket"], r["n"]) for r in got] == [(t.date(), n) for t, n in wanted.items()]
