"""The cosine join of sentences against all pairs, with ordinary, hot and tiled lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import paraphrases as P


def plain(rows, percent):
    told = {}
    for key, pos, s in rows:
        words = re.findall(r"[^\W_]+", s.lower())
        if words:
            told.setdefault(tuple(sorted(words)), []).append((key, pos))
    vectors = {w: Counter(w) for w in told}
    pairs, links = set(), {w: len(at) - 1 for w, at in told.items()}
    for a, x in vectors.items():
        for b, y in vectors.items():
            if a < b:
                dot, n = sum(c * y[t] for t, c in x.items()), sum(c * c for c in x.values()) * sum(c * c for c in y.values())
                if 10_000 * dot * dot >= percent**2 * n:
                    one, two = sorted((a, b), key=lambda w: min(told[w]))
                    name = lambda w: "%d:%d" % min(told[w])
                    pairs.add((name(one), name(two), len(told[one]), len(told[two]), round(dot / math.sqrt(n), 9)))
                    links[a] += len(told[b])
                    links[b] += len(told[a])
    return pairs, {at: ("%d:%d" % min(own), links[w]) for w, own in told.items() for at in own if links[w]}


def made(seed, n, common, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        size = r.choice([0, 1, 2, 3, 6, 10, 14])
        s = [r.choice(vocabulary) if r.random() > common else r.choice(["the", "of"]) for _ in range(size)]
        s += ["the"] * r.choice([0, 0, 0, 1, 12]) if common else []
        out.append((i // 3, i % 3, " ".join(s) + r.choice(["", "!", " …"])))
        if r.random() < .5 and out[-1][2]:  # a near copy
            near = list(s)
            r.shuffle(near)
            if near and r.random() < .7:
                near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append((1000 + i, 0, " ".join(near).upper()))
    return out


@pytest.mark.parametrize("seed, hot, long, percent", [(1, 2048, 1024, 90), (3, 10, 8, 90), (4, 10, 8, 70)])
def test_equals_all_pairs(spark, monkeypatch, seed, hot, long, percent):
    monkeypatch.setattr(P, "HOT", hot)
    monkeypatch.setattr(P, "LONG", long)
    rows = made(seed, 250, 0.5)
    df = spark.createDataFrame(rows, "document_id long, pos int, sentence string")
    pairs, links = plain(rows, percent)
    got = P.paraphrase_pairs(df, "document_id", percent).collect()
    assert len(got) == len(pairs) > 20
    assert {(r["first_1"], r["first_2"], r["copies_1"], r["copies_2"], round(r["similarity"], 9)) for r in got} == pairs
    assert {(r["document_id"], r["pos"]): (r["class_id"], r["links"]) for r in P.paraphrase_links(df, "document_id", percent).collect()} == links


def test_hot_words_meet_fewer_classes(spark, monkeypatch):
    """300 sentences that share one word and differ in the rest aren't brought together by it."""
    monkeypatch.setattr(P, "HOT", 50)
    rows = [(i, 0, f"the a{i} b{i % 20}") for i in range(300)]
    df = spark.createDataFrame(rows, "document_id long, pos int, sentence string")
    index = P.postings(P.vectors(P.classes(df, "document_id")), 90)
    assert max(r["count"] for r in index.groupBy("code", "second").count().collect()) <= 50
    assert P.paraphrase_pairs(df, "document_id").count() == 0


def test_no_sentences(spark):
    df = spark.createDataFrame([(1, 0, "…"), (2, 0, "")], "document_id long, pos int, sentence string")
    assert P.paraphrase_pairs(df, "document_id").collect() == [] == P.paraphrase_links(df, "document_id").collect()


def test_index_holds_no_vectors(spark, monkeypatch):
    """A posting's size doesn't depend on the words of its class, and lists that go over batches of Arrow are whole."""
    rows = made(7, 150, 0.5)
    df = spark.createDataFrame(rows, "document_id long, pos int, sentence string")
    index = P.postings(P.vectors(P.classes(df, "document_id")), 90)
    assert not [c for c, t in index.dtypes if t.startswith(("array", "struct", "string", "binary"))]
    monkeypatch.setattr(P, "HOT", 10)
    monkeypatch.setattr(P, "LONG", 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = P.paraphrase_links(df, "document_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["document_id"], r["pos"]): (r["class_id"], r["links"]) for r in got} == plain(rows, 90)[1]


def test_long_sentences_meet_few_others(spark):
    """Their 128 bits are all set, so only the number and the groups of their words tell short sentences and other long ones from them; near copies still meet."""
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    long = [r.choices(vocabulary, k=220) + ["the"] * r.choice([5, 30]) for _ in range(60)]
    near = [w[1:] + ["new"] for w in long[:20]]
    rows = [(i, 0, " ".join(w)) for i, w in enumerate([*long, *near, *([f"the s{i}", f"t{i}"] for i in range(60))])]
    df = spark.createDataFrame(rows, "document_id long, pos int, sentence string")
    x = P.postings(P.vectors(P.classes(df, "document_id")), 90).toPandas().drop_duplicates("id")
    x = {c: x[c].to_numpy() for c in x} | {"list": np.zeros(len(x), np.int64), "side": np.zeros(len(x), np.int64), "share": np.ones(len(x))}
    x |= {c: x[c].view(np.uint64) for c in ("b0", "b1")}
    a, _ = P.met_in(x, .81 - 1e-6)
    pairs, links = plain(rows, 90)
    assert len(x["id"]) == 140 and len(pairs) <= len(a) < 2000  # 4840 before, most of them of a long and a short one
    got = {(r["first_1"], r["first_2"]) for r in P.paraphrase_pairs(df, "document_id").collect()}
    assert got == {p[:2] for p in pairs} and len(got) >= 20


def test_lists_meet_in_stretches_and_blocks(spark, monkeypatch):
    """Classes of a list meet those alone whose number of words may be near their own, in blocks or side by side; what is found doesn't depend on that."""
    df = spark.createDataFrame(made(9, 400, 0.5), "document_id long, pos int, sentence string")
    x = P.postings(P.vectors(P.classes(df, "document_id")), 90).toPandas()
    x["list"] = x["code"] % 3
    x = x.sort_values("list")
    x = {c: x[c].to_numpy() for c in x} | {"side": np.zeros(len(x), np.int64)}
    x |= {c: x[c].view(np.uint64) for c in ("b0", "b1")}
    least, told = .81 - 1e-6, []
    for dense, block, some in ((10**9, 1, 10**9), (2, 7, 5), (64, 96, 50_000)):
        monkeypatch.setattr(P, "DENSE", dense)
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P, "SOME", some)
        a, b = P.met_in(x, least)
        assert (x["list"][a] == x["list"][b]).all() and all(len(p[0]) <= some for p in P.met_parts(x, least))
        told.append(sorted(map(tuple, np.sort(np.stack([a, b], 1), 1).tolist())))
    assert told[0] == told[1] == told[2] and len(told[0]) > 100
    # a list of sentences of all lengths: pairs are looked at only where lengths may fit; all 179700 were before
    n = 600
    d = np.arange(n) % 60 + 1
    bits = np.array([(1 << int(k)) - 1 for k in d], np.uint64)
    y = {"list": np.zeros(n, np.int64), "side": np.zeros(n, np.int64), "id": np.arange(n), "share": np.ones(n, np.float32), "n2": d, "d": d, "b0": bits, "b1": bits * 0, "e0": d * 0, "e1": d * 0}
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(P, "DENSE", 10**9)
    monkeypatch.setattr(P.np, "bitwise_count", lambda v: (seen.append(len(v)), count(v))[1])
    P.met_in(y, least)
    assert max(seen) <= n and sum(seen) < 2 * 179_700  # four counts a pair that is looked at


def test_only_classes_with_links_are_joined(spark, monkeypatch):
    """Beyond SENT, texts of classes that no pair asks for are left out before they are shuffled, as are sentences without a link; nothing is lost by the table of bits."""
    monkeypatch.setattr(P, "SENT", 10)
    monkeypatch.setattr(P, "BITS", 1 << 17)
    rows = made(11, 200, 0.5)
    df = spark.createDataFrame(rows, "document_id long, pos int, sentence string")
    ids = spark.range(1000).filter("id % 7 = 0")
    near = spark.range(1000).filter(P.among("id", P.spotted(ids)))
    assert {i * 7 for i in range(143)} <= {r["id"] for r in near.collect()} and near.count() < 160
    pairs, links = plain(rows, 90)
    assert len(P.paraphrase_pairs(df, "document_id").collect()) == len(pairs) > 20
    assert {(r["document_id"], r["pos"]): (r["class_id"], r["links"]) for r in P.paraphrase_links(df, "document_id").collect()} == links


def test_sentences_are_cut_into_words_once(spark):
    """A filter on the words themselves had them worked out twice."""
    df = spark.createDataFrame([(1, 0, "Ⅻ b"), (2, 0, "…"), (3, 0, "İ"), (4, 0, "")], "document_id long, pos int, sentence string")
    for told in (P.classes(df, "document_id"), P.members(df, "document_id")):
        assert told._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        assert told.count() == 2
