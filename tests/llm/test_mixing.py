"""The mix against its laws, targets against plain resharing, and a plain schedule."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string, sid int"


def plain_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Share by weight, cut what is above, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, Fraction(0)), share * sum(sizes.values()), set(names)
    while left and free:
        part = left / sum(weight[s] for s in free)
        left = Fraction(0)
        for s in list(free):
            got[s] += part * weight[s]
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = Fraction(most * sizes[s])
                free.discard(s)
    return got


def made(seed, n=600):
    r = random.Random(seed)
    sources = ["a", "b", "Z", "é", "\U0001f600", "￿", "", None, "hot"]
    rows = [(r.choice([None, *range(500)]) if r.random() < .2 else i + 1000, r.choice([None, "", "x " * r.randrange(200), "one\x0btwo\x1fthree"]), r.choice(sources) if r.random() < .6 else "hot") for i, _ in enumerate(range(n))]
    return rows + rows[:40] + [(77, "long " * 30_000, "b"), (78, None, "empty")]


def df(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)


def words(text):
    return len((text or "").replace("\x0b", " ").split(" ")) - (text or " ").replace("\x0b", " ").endswith(" ") if text else 0


def check(spark, rows, block):
    docs = df(spark, rows)
    got = mixing.taken(docs, block=block).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), words(t)) for d, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    wanted = plain_targets(sizes)
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(float(x), 6) for x in wanted.values()})
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    mix, told = mixing.mixture(docs, block=block)
    by = {r["at"]: r for r in told.collect()}
    pieces = sorted((r["slot"], r["place"], r["words"], r["at"], r["first"]) for r in mix.collect())
    # every slot is one source's run of words, full but for each source's last
    slots = {}
    for slot, place, n, at, first in pieces:
        assert n > 0 and place == sum(p[1] for p in slots.get(slot, [])) and 0 <= first and first + n <= by[at]["size"]
        slots.setdefault(slot, []).append((at, n))
    assert all(sum(n for _, n in s) <= block and len({(by[at]["source_size"], by[at]["target"]) for at, _ in s}) == 1 for s in slots.values())
    per = {}
    for s in slots.values():
        k = by[s[0][0]]["source_size"], by[s[0][0]]["target"]
        per[k] = per.get(k, 0) + sum(n for _, n in s)
    same = {}
    for s, x in wanted.items():
        k = sizes[s], round(float(x), 6)
        same[k] = same.get(k, 0) + 1
    for (size, target), n in per.items():
        assert abs(n - target * same[size, round(target, 6)]) <= same[size, round(target, 6)]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(7), block=block).collect()), key=str)


def test_laws(spark):
    check(spark, made(1), 50)
    check(spark, made(2), 1024)


def test_shares_of_every_stretch(spark):
    """The first tenth of the mix has the shares of the whole."""
    rows = [(i, "w " * 40, s) for i, s in enumerate("abc" * 1500)]
    mix, told = mixing.mixture(df(spark, rows), block=64)
    met = mix.join(told.select("at", "target"), "at")
    last = met.agg(F.max("slot")).first()[0]
    target = {r["target"]: r["n"] for r in met.groupBy("target").agg(F.sum("words").alias("n")).collect()}
    early = {r["target"]: r["n"] for r in met.filter(F.col("slot") < last // 10).groupBy("target").agg(F.sum("words").alias("n")).collect()}
    for t, n in target.items():
        assert abs(early[t] / sum(early.values()) - n / sum(target.values())) < 0.02


def test_many_rows_that_are_alike_and_many_sources(spark):
    rows = [(None, "same words here", "hot")] * 9000 + [(5, "again and again", "hot")] * 5000 + [(i, "a b c d", f"s{i % 700}") for i in range(2100)]
    docs = df(spark, rows)
    got = mixing.taken(docs, block=16)
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("n"), F.count("*").alias("rows"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert sum(r["rows"] for r in sums) == len(rows) and all(r["over"] <= 0 for r in sums)
    for r in sums:
        k = 1 if r["source_size"] > 100 else r["rows"] / 3
        assert abs(r["n"] / k - r["target"]) <= 0.51


def test_empty_and_wordless_tables(spark):
    assert mixing.taken(df(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.taken(df(spark, [(1, None, "a"), (2, " \n", None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
