"""The filter audit against applying the filters one by one."""

import random
import re
from itertools import permutations

from tidemark.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string, part int, mask int, words string, first string", "doc_id long, quality int, toxic int, good int"


def plain(docs, labels):
    """Each order applied to each document, filter by filter."""
    docs = [(d, t or "", s or "") for d, t, s in docs]

    def fails(c, d, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        if c == "A":
            return len(words) < 200
        if c == "B":
            return 100 * len(set(words)) < 50 * len(words)
        if c == "C":
            return 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)
        if c == "D":
            return bool(re.search(r"[#$%&*|]", t))
        return d is not None and any(o is not None and o < d and u == t for o, u, _ in docs)

    told = [(s, {c for c in "ABCDE" if fails(c, d, t)}, any(x[0] == d and x[1] == 1 for x in labels), any(x[0] == d and x[2] == 1 for x in labels)) for d, t, s in docs]
    out, shapley = {}, {}
    for part in {t[0] for t in told}:
        own = [t for t in told if t[0] == part]
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, c in enumerate(order, 1):
                gone = [t for t in alive if c in t[1]]
                alive = [t for t in alive if c not in t[1]]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(c in t[1] for t in own) - len(gone), sum(t[1] == {c} for t in own), sum(t[2] for t in gone), sum(t[3] for t in gone)]
    return {(p, o, s): [*v, shapley[p, o[s - 1]]] for (p, o, s), v in out.items()}


def found(spark, docs, labels):
    rows = filter_audit.marked(spark.createDataFrame([(*d, 1, 2, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*x, 9) for x in labels], LABELS))
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit(rows).collect()}


def made(seed):
    r = random.Random(seed)

    def text():
        words = [r.choice("abc") if r.random() < .3 else f"w{r.randrange(400)}" for _ in range(r.choice([0, 3, 120, 199, 200, 260]))]
        t = r.choice([" ", "\n", "\x1f "]).join(words)
        return r.choice([t, t, t.upper(), t + " #", t[:len(t) // 4].upper() + t, None, "", " ".join(words)])

    texts = [text() for _ in range(25)]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["a", "b", "", None])) for _ in range(80)]
    docs += docs[:6]  # repeated rows
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(50)]
    return docs, labels


def test_audit_equals_applying_the_filters(spark):
    for seed in range(2):
        docs, labels = made(seed)
        assert found(spark, docs, labels) == plain(docs, labels)


def test_hot_text_and_hot_rows_without_ids(spark):
    docs = [(i, "same words " * 150, "s") for i in range(150)] + [(None, "same words " * 150, "s")] * 60 + [(1000 + i, f"own {i}", "s") for i in range(90)]
    labels = [(i, 1, 0) for i in range(0, 1100, 3)]
    assert found(spark, docs, labels) == plain(docs, labels)


def test_all_parts_have_all_orders(spark):
    got = found(spark, [(1, "x", "a"), (2, "word " * 300 + "and " * 2, None)], [])
    assert len(got) == 2 * 600 and {k[0] for k in got} == {"a", ""}
    assert found(spark, [], []) == {}
    long = " ".join(f"w{i}" for i in range(300_000))
    assert found(spark, [(1, long, "a")], [(1, 1, 1)])["a", "ABCDE", 5] == [1, 0, 0, 0, 0, 0, 0]


def test_survivors_of_every_subset():
    import numpy as np

    r = np.random.default_rng(0)
    masks, weights = np.arange(64), r.integers(0, 1 << 40, (64, 3))
    states = filter_audit.survivors(masks, weights, 6)
    for s in range(64):
        assert (states[s] == weights[(masks & s) == 0].sum(0)).all()
