"""Decontamination against a plain definition, and re-parameterised items that once were missed."""

import functools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def ids(spark, docs, items):
    found = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return sorted({(r["doc_id"], r["item_id"]) for r in found.collect()}, key=str)


def test_openers_cases_and_names_of_several_words(spark):
    items = [(1, "Tom buys 5 red apples yesterday morning"), (2, "Boston lies 300 miles from the nearest harbour and gets snow in winter"), (3, "12 34 56"), (4, "it is as it is"), (5, "...")]
    docs = [(1, "Anna buys 7 red apples yesterday morning"), (2, "They say Anna buys 7 red apples yesterday morning."), (3, "tom buys 9 red apples yesterday morning"), (4, "TOM sells red apples"),
            (5, "New York lies 40 miles from the nearest harbour and gets snow in winter"), (6, "as told, boston lies 300 miles from the nearest harbour and gets snow in winter"), (7, "the sum of 12 34 56 is"), (8, "11 34 56"), (9, "so it is as it is"), (10, "it was as it is"), (11, "... ...")]
    assert ids(spark, docs, items) == sorted([(1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (7, 3), (9, 4)], key=str)


def test_units_by_place(spark):
    """Units of no list, and one that a list has against one that it hasn't; another text around them doesn't match."""
    items = [(1, "A cart moves 12 kilometers in 3 hours along the canal and stops twice"), (2, "It takes 15 km of copper wire to join both villages")]
    docs = [(1, "A cart moves 15 miles in 4 days along the canal and stops twice"), (2, "A cart moves 15 pounds in 4 weeks along the canal and stops twice"), (3, "It takes 12 kilometers of copper wire to join both villages"),
            (4, "It takes 12 spools of copper wire to join both villages"), (5, "A cart waits 15 miles beyond 4 days and the canal stops twice"), (6, "It takes copper wire to join 15 km of villages")]
    assert ids(spark, docs, items) == sorted([(1, 1), (2, 1), (3, 2), (4, 2)], key=str)


def plain_contaminated(docs, items, width=8, least=3):
    number = lambda w: re.fullmatch(r"[+-]?\d[\d.,:/]*[^\W\d_]{0,3}", w) is not None
    bare = lambda w: w.strip(D.EDGES)
    name = lambda w: re.fullmatch(r"[A-Z][a-z]+(?:[_'’-][A-Za-z]+)*", w) is not None

    def cut(text):
        merged = re.sub(r"(?:(?<=\s)|(?<=[(\"“])|^)([A-Z][a-z]{1,40}(?:\s+[A-Z][a-z]+)+)", lambda m: re.sub(r"\s+", "_", m[1]), text)
        return [text] + [merged] * (merged != text)

    @functools.cache
    def readings(tokens):
        out = []
        for unit, kind in [(u, k) for u in (lambda x: x in D.UNITS, lambda x: re.fullmatch(r"[^\W\d_]+", x) is not None) for k in range(3)]:
            t = []
            for i, w in enumerate(tokens):
                before = tokens[i - 1] if i else ""
                opens = before == "" or re.search(r"[.!?]\W*$", before) is not None
                low = bare(w).lower()
                t.append("<num>" if number(low) else "<unit>" if number(bare(before)) and unit(low) else "<name>" if name(bare(w)) and (kind == 1 or kind == 0 and not opens) else low)
            telling = sum(bool(x) and not x.startswith("<") for x in t) >= D.LITERALS
            out.append(tuple(t) if telling else tuple(bare(w).lower() for w in tokens))
        return [t for t in dict.fromkeys(out) if any(x and not x.startswith("<") for x in t)]

    found = set()
    for i, item in items:
        for item_cut in cut(item or ""):
            tokens = item_cut.split()
            if not tokens:
                continue
            starts = range(max(1, len(tokens) - width + 1))
            windows = {at: (tokens[at:at + width], readings(tuple(tokens[at:at + width]))) for at in starts}
            can = [at for at in windows if windows[at][1]]
            for d, text in docs:
                hit = set()
                for doc_cut in cut(text or ""):
                    w = doc_cut.split()
                    places = defaultdict(set)
                    for at in can:
                        own_tokens, own = windows[at]
                        for s in range(len(w) - len(own_tokens) + 1):
                            theirs = w[s:s + len(own_tokens)]
                            for t in {*own} & {*readings(tuple(theirs))}:
                                places[s - at].add((at, tuple((x, bare(b).lower(), bare(o).lower()) for x, b, o in zip(t, own_tokens, theirs) if x.startswith("<"))))
                    for matches in places.values():
                        said = Counter(s for _, slots in matches for s in slots)
                        best = {}
                        for (x, b, o), n in said.items():
                            best[x, b] = max(best.get((x, b), (0, "")), (n, o))
                        hit |= {at for at, slots in matches if all(best[x, b][1] == o for x, b, o in slots)}
                if can and len(hit) >= min(least, len(can)):
                    found.add((d, i))
    return sorted(found, key=str)


@pytest.mark.parametrize("bound", [500_000, -1])
def test_equals_the_plain_definition(spark, monkeypatch, bound):
    """Broadcast or shuffled, texts of few words with numbers, names, units and shared passages."""
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", bound)
    r = random.Random(8)
    vocabulary = ["the", "a", "of", "train", "leaves", "apples", "bought", "to", "is", "river", "counts", "x", "Oslo", "Rome", "Anna", "Tom", "5", "17", "3.5", "km", "hours", "Then", "end.", "Why?"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(3, 16))) for i in range(14)] + [(3, None), (None, "the river counts 5 apples of Tom")]
    swap = lambda t: re.sub(r"\b(5|17|Oslo|Rome|Anna|Tom)\b", lambda m: r.choice(["5", "17"] if m[0].isdigit() else ["Oslo", "Rome", "Anna", "Tom", "Big Ben"]), t)
    docs = [(i, text(r.randint(0, 10)) + " " + (swap(r.choice(items)[1] or "") if i % 3 else text(12)) + " " + text(r.randint(0, 10))) for i in range(90)] + [(None, items[0][1]), (5, None), (5, ""), (1, "so the river counts 9 apples of Rome")]
    docs = [(i, " ".join(t.split()) if t else t) for i, t in docs]
    assert ids(spark, docs, items) == plain_contaminated(docs, items)


def test_long_texts(spark):
    """A match at the end of a long text; repeated rows; columns that the operator uses inside."""
    item = "every basket of ripe plums weighs 12 kg before noon"
    docs = spark.createDataFrame([(1, "filler words " * 100_000 + item.replace("12", "40")), (1, item), (2, "filler " * 1000)], DOCS).withColumn("cut", F.lit(1)).withColumn("w", F.lit("x"))
    found = D.contaminated(docs, spark.createDataFrame([(1, item), (1, item)], ITEMS).withColumn("at", F.lit(1))).collect()
    assert [(r["doc_id"], r["item_id"], r["item_windows"]) for r in found] == [(1, 1, 3)]
