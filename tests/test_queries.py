"""Queries against their SQL on the smallest tables; the rest of the list is run by the driver."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["clean_documents", "split_paragraphs", "registered_domain", "date_ranges", "topic_info_enrich", "topic_centroid", "merge_step", "signal_popularity", "classify_signals", "sankey_links", "class_tfidf", "topic_embedding_stability", "quality_breakdown", "equal_count_bins", "stream_popularity_state"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and got == wanted and got


def test_every_query_is_callable_and_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0
