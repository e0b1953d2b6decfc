"""Disclosing terms against an estimate by brute force on planted texts; steps of generalisation; hot entities."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

DOCS = "doc_id long, text string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def planted():
    r = random.Random(6)
    plain = [f"{a}{b}" for a in "ba de fi go hu ki lo mu".split() for b in "ra se ti vo zu".split()]
    rows = []
    for i in range(400):
        w = [r.choice(plain) for _ in range(r.randint(5, 30))]
        if i % 2 == 0:  # one address in half of all documents, others more rarely; each has a word that gives it away more or less
            who = 0 if i % 4 == 0 else r.randint(1, 12)
            at = r.randint(0, len(w))
            w[at:at] = [f"{r.choice(['Zorb', 'zorb'])}{'abcdefghijklm'[who]}" if r.random() < 0.8 else "nobody", f"u{who}@corp.org"]
        if r.random() < 0.1:
            w.append(f"zorb{'abcdefghijklm'[r.randint(0, 12)]}")
        rows.append((i, " ".join(w)))
    return rows + rows[:3] + [(None, rows[0][1]), (1000, None)]


def estimate(rows, posterior=0.5, bits=4.0, support=3):
    low = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    around, total, n = defaultdict(list), len(rows), Counter()
    for _, t in rows:
        t = t or ""
        n.update(low(t))
        for m in EMAIL.finditer(t):
            before = re.sub(r"^[^\W\d_]+", "", t[max(0, m.start() - pii.CONTEXT):m.start()])
            after = re.sub(r"[^\W\d_]+$", "", t[m.end():m.end() + pii.CONTEXT])
            around[m[0]].append(tuple(dict.fromkeys(low(before) + low(after))))
    found = set()
    for entity, contexts in around.items():
        for term in {x for c in contexts for x in c}:
            having = [c for c in contexts if term in c]
            p = len(having) / max(n[term], len(having))
            if len(set(having)) >= support and p >= posterior and math.log2(p / (len(contexts) / total)) >= bits:
                found.add((term, f"email:{entity}"))
    return found


def test_terms_equal_the_estimate(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS)
    based = pii.base_spans(docs).select("doc_id", "base", pii.mentions(F.col("base"), F.col("text")).alias("mentions"))
    for limits in ({}, {"bits": 0.5}, {"posterior": 0.8, "bits": 1.0}):
        got = {(r["term"], r["entity"]) for r in pii.disclosing_terms(based, docs, **limits).collect()}
        assert got == estimate(rows, **limits) and got


@pytest.mark.parametrize("bound", [200_000, 0])
def test_spans_of_terms(spark, monkeypatch, bound):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
    rows = planted()
    told = {t for t, _ in estimate(rows, bits=0.5)}
    got = sorted(((r["doc_id"], [(s["start"], s["stop"]) for s in r["extra"]]) for r in pii.find_spans(spark.createDataFrame(rows, DOCS), bits=0.5).collect()), key=str)
    want = [(i, [m.span() for m in re.finditer(r"[^\W\d_]+", t or "") if m[0].lower() in told and not any(e.start() < m.end() and m.start() < e.end() for e in EMAIL.finditer(t))]) for i, t in rows]
    assert got == sorted(want, key=str)


def test_steps_of_generalisation_and_protected_patterns(spark):
    texts = [f"case {n} was met by Quill near the {w} on a day of rain, said K-{77} again" for n, w in ((1, "mill"), (2, "pond"), (3, "barn"), (4, "well"))] + ["Quill"] + [f"rain over the {w}" for w in ("mill", "pond", "barn", "well")] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    clean = lambda **k: {r["doc_id"]: r["text"] for r in pii.sanitise(docs, protected={"case": r"K-[0-9]+"}, **k).collect()}
    assert "Quill" in {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}[4]
    assert clean()[4] == "[TERM]" and clean(general=0.95, removal=0.99)[4] == "[NAME]" and clean(removal=0.8)[4] == "" and clean()[10] == texts[10]


def test_clashing_columns_pass_through(spark):
    rows = [(1, "write to ann@mail.example now", "b", ["e"], 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, extra array<string>, mentions int")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(1, "write to [EMAIL] now", "b", ["e"], 7), (None, "", None, None, None)], key=str)
    assert pii.summary(pii.find_spans(docs)).filter("doc_id = 1").first()["n_email"] == 1
