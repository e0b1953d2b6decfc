"""Packing against the definition, and a hot text under one id."""

import numpy as np
import pytest

from tidemark.llm import sharding


def plain_pack(weights, shards):
    """Each group, largest first, where the dot product with what is left is highest, among shards with room for its bytes."""
    total = [max(sum(w[k] for w in weights), 1) for k in range(3)]
    share = [[w[k] / total[k] * shards for k in range(3)] for w in weights]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-share[i][0], -sum(share[i]), i)):
        room = [s for s in range(shards) if left[s][0] >= share[i][0]]
        dot = lambda s: sum(left[s][k] * share[i][k] for k in range(3))
        best = max(room, key=lambda s: (dot(s), -s)) if room else max(range(shards), key=lambda s: (left[s][0], -s))
        out[i] = best
        left[best] = [left[best][k] - share[i][k] for k in range(3)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pack_equals_the_definition(seed):
    r = np.random.default_rng(seed)
    w = np.column_stack([r.integers(1, 60, 50), r.integers(0, 30, 50), np.ones(50, int)]).astype(float)
    assert sharding.pack(w, 2 + seed).tolist() == plain_pack(w.tolist(), 2 + seed)


def test_hot_text_without_ids_is_split(spark):
    rows = [(None, "hot " * 40)] * 600 + [(7, "warm " * 40)] * 600 + [(i, f"text {i}") for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == 1500 and size.max() / size.mean() < 1.05 and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_groups_that_fit_stay_whole(spark):
    """Groups of all sizes up to a shard's lie in one shard each; those above, and those that find no room, are split; sizes stay equal."""
    rows = [(i, f"small {i} " * (i % 7)) for i in range(3000)]
    for g, n in enumerate([2, 3, 10, 50, 120, 200, 250, 300, 2500]):
        rows += [(100_000 * (g + 1) + i, f"group {g} of equal texts") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_documents(df, 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and size.max() / size.mean() < 1.01 and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    texts = dict(rows)
    capacity = size.sum() / 8
    of = got.assign(text=[texts[i] for i in got["doc_id"]]).groupby("text").agg(shards=("shard", "nunique"), bytes=("size", "sum"))
    assert (of[of["bytes"] <= capacity]["shards"] == 1).all() and of[of["bytes"] > capacity]["shards"].min() > 1


def test_pack_keeps_groups_together_while_there_is_room():
    w = np.array([[4, 1, 1], [4, 1, 1], [4, 1, 1], [4, 1, 1], [5, 1, 1], [5, 1, 1], [2, 1, 1], [2, 1, 1]], float)
    groups = np.array([0, 0, 1, 1, -1, -1, 2, 2])
    out = sharding.pack(w, 3, groups)
    assert out[0] == out[1] and out[2] == out[3] and len({out[0], out[2]}) == 2
    hot = sharding.pack(np.ones((30, 3)), 3, np.zeros(30, int))
    assert np.bincount(hot).tolist() == [10, 10, 10]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_given_group_is_split(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sharding.shard_documents(docs).toPandas().merge(docs.selectExpr("doc_id", "md5(coalesce(text, '')) AS d").toPandas(), on="doc_id")
    size = got.groupby("shard")["size"].sum()
    of = got.groupby("d").agg(shards=("shard", "nunique"), bytes=("size", "sum"))
    assert (of[of["bytes"] <= size.sum() / 40]["shards"] == 1).all()
    assert sf == "sf0.001" or size.max() / size.mean() < 1.05
