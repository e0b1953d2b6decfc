"""Cases that a bound, a sketch or a pooled decision once lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, pii

DOCS = "doc_id long, text string"


def letters(i):
    return "".join(chr(97 + int(c)) for c in f"{i:05d}")


def test_every_entity_of_just_enough_contexts(spark):
    seen = [(3 * i + k, f"On {w} Kq{letters(i)} wrote from u{i}@corp.org about {b}.") for i in range(3000) for k, (w, b) in enumerate((("Yesterday", "apples"), ("Friday", "prices"), ("Later", "trains")))]
    docs = spark.createDataFrame(seen, DOCS).repartition(4)
    based = pii.base_spans(docs).select("doc_id", "base", pii.mentions(F.col("base"), F.col("text")).alias("mentions"))
    found = pii.disclosing_terms(based, docs)
    assert {r["entity"] for r in found.filter(F.col("term").startswith("kq")).collect()} == {f"email:u{i}@corp.org" for i in range(3000)}


def test_short_names_disclose(spark):
    texts = [f"On {a} Kim wrote from chief@corp.org about {b}." for a, b in (("Yesterday", "apples"), ("Friday", "prices"), ("Later", "trains"))]
    texts += [f"nothing of {w} here, we wrote from home about plain words" for w in ("apples", "prices", "trains")] * 20 + ["Kim alone"]
    found = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [s["value"] for s in found[len(texts) - 1]["extra"]] == ["Kim"] and not found[5]["extra"]


def test_each_copy_of_an_item_has_its_own_slots(spark):
    item = "a pot of 5 red figs and 8 big nuts"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    # of three copies each slot's most frequent value comes from two different copies, so that no copy has them all
    sheet = " . ".join(item.replace("5", x).replace("8", y) for x, y in (("11", "21"), ("11", "22"), ("12", "22"), ("13", "21"), ("14", "20"), ("11", "19")))
    docs = spark.createDataFrame([(7, sheet), (8, item.replace("5", "30").replace("8", "40")), (9, "a pot of red figs and nuts")], DOCS)
    assert sorted(r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()) == [7, 8]
    two = spark.createDataFrame([(7, item.replace("5", "11").replace("8", "99") + " . " + "x " * 4 + item.replace("5", "98").replace("8", "21"))], DOCS)
    assert decontaminate.contaminated(two, bench).count() == 1


def test_passages_of_short_words_count(spark):
    """Three windows have a long word; the passage copied has none."""
    short = "let f be the map from x to y and let g be its dual so that f of x is g of y for all x in the set"
    bench = spark.createDataFrame([(1, short + " . Consider continuous transformations everywhere between topological manifolds having boundary")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "as said , " + short + " , we go on"), (6, "let us be the first from x to y and so on")], DOCS)
    assert [r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()] == [5]


def near_copies(n, words=60, most=3):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(r.randint(1, most)):
            t[r.randrange(words)] = f"e{r.randrange(10**7)}"
        rows.append((i, "alpha beta gamma delta epsilon " + " ".join(t)))
    return rows


def linked(sets):
    """Components by comparing every pair."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("tile,shingles", [(2048, 2_000_000), (40, 500)])
def test_one_large_group_of_near_copies(spark, monkeypatch, tile, shingles):
    """One prefix shingle for all; large tiles and regions go by hubs, labels and pairs of tiles, with the same result."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", shingles)
    rows = near_copies(500)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    w = [t.split() for _, t in rows]
    want = linked([{tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in w])
    assert [got[i] for i in range(len(rows))] == want


def test_tiles_by_arrays_equal_tiles_by_pairs(monkeypatch):
    r = np.random.default_rng(2)
    universe = r.integers(-2**62, 2**62, 3000)
    sets = [np.unique(r.choice(universe[k * 300:(k + 2) * 300], int(r.integers(100, 700)))) for k in range(8) for _ in range(12)]
    sets.sort(key=len)
    tile = [(i, i, i % 2, (len(s), int.from_bytes(b := ngram_join.signature(s), "little"), 8 * len(b))) for i, s in enumerate(sets)]
    for t in (tile, [(c, x, 0, y) for c, x, _, y in tile]):
        groups = []
        for wide in (2, 1000):
            monkeypatch.setattr(ngram_join, "WIDE", wide)
            g = ngram_join.Groups()
            ngram_join.candidate_links(t, g, 40)
            groups.append(sorted(sorted(x for x in range(len(sets)) if g.root(x) == y) for y in {g.root(x) for x in range(len(sets))}))
        assert groups[0] == groups[1] and 1 < len(groups[0]) < len(sets)
