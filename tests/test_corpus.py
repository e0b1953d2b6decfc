"""Operators without SQL against plain versions: coherence, re-ranking, merging, stability, embeddings, duplicates of sentences."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as C, merging, stability as B, summaries as M, topics as O
from tidemark.operators.written import save
from tidemark.plans import reports
from tidemark.streaming.streams import setting


def test_coherence_counts_windows(spark):
    docs = [(1, "one two three four one five"), (2, "two three six"), (3, "seven"), (4, "one two one two one two one two one two one two")]
    words = [(0, ["one", "two", "three"]), (1, ["five", "six"])]
    got = {r["topic"]: r for r in O.coherence(spark.createDataFrame(words, "topic int, words array<string>"), spark.createDataFrame(docs, "document_id long, text string"), window=3).collect()}
    windows = [set(w[i:i + 3]) for _, t in docs for w in [t.split()] for i in range(max(1, len(w) - 2))]
    n = len(windows)
    for topic, own in words:
        pmi, norm = [], []
        for b, a in combinations(own, 2):
            both = sum({a, b} <= w for w in windows) / n
            value = math.log((both + 1e-12) / (sum(a in w for w in windows) / n * sum(b in w for w in windows) / n + 1e-24))
            pmi.append(value)
            norm.append(value / -math.log(both + 1e-12))
        assert got[topic]["c_uci"] == pytest.approx(np.mean(pmi)) and got[topic]["c_npmi"] == pytest.approx(np.mean(norm))
    sets = [set(t.split()) for _, t in docs]
    mass = [math.log((sum({a, b} <= s for s in sets) + 1) / max(1, sum(b in s for s in sets))) for b, a in combinations(words[0][1], 2)]
    assert got[0]["u_mass"] == pytest.approx(np.mean(mass))


def test_mmr_weighs_nearness_and_distance(spark):
    rows = [(0, "near", [1.0, 0.1], [1.0, 0.0]), (0, "same", [1.0, 0.11], [1.0, 0.0]), (0, "side", [0.6, -0.8], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "topic int, word string, embedding array<double>, centroid array<double>")
    assert [r["word"] for r in M.mmr(df, "topic", 2, 0.7).orderBy("rank").collect()] == ["near", "side"]
    assert [r["word"] for r in M.mmr(df, "topic", 2, 0.0).orderBy("rank").collect()] == ["near", "same"]


def test_reranking_goes_on_with_joins_that_shuffle(spark, small):
    """As with large tables, where no side is broadcast: parts of a union in the mean of vectors no longer come out as another number than the other side's."""
    told = []
    for limit in ("10m", "-1"):
        with setting(spark, "spark.sql.autoBroadcastJoinThreshold", limit):
            told.append(sorted(map(tuple, reports.mmr_rerank(spark, small).collect())))
    assert told[0] == told[1] and len(told[0]) == 45


def simulate_merges(periods, minimum):
    cosine = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    registry, log = {}, []
    for k, (date, topics) in enumerate(periods):
        before = dict(registry)
        for t, v, n in topics:
            best = max(before, key=lambda r: (cosine(before[r][0], v), -r), default=None)
            if best is not None and cosine(before[best][0], v) >= minimum:
                log.append((periods[k - 1][0], best, t, before[best][1], n))
                registry[best] = (registry[best][0], registry[best][1] + n)
            else:
                registry[max(registry, default=-1) + 1 if k else t] = (v, n)
    return registry, log


def test_all_periods_equal_a_simulation(spark):
    r = np.random.default_rng(4)
    periods = [(f"2024-01-{1 + 7 * k:02d}", [(t, r.normal(size=3).tolist(), int(r.integers(1, 9))) for t in range(5)]) for k in range(4)]
    rows = [(date, t, v, n, n, ["s"]) for date, topics in periods for t, v, n in topics]
    df = spark.createDataFrame(rows, "period string, topic int, embedding array<double>, count long, document_count long, sources array<string>").withColumn("period", F.col("period").cast("date"))
    registry, log = merging.merge_all_periods(df, 0.8, save)
    wanted, merges = simulate_merges(periods, 0.8)
    assert {x["topic"]: x["document_count"] for x in registry.collect()} == {t: n for t, (_, n) in wanted.items()}
    assert sorted((str(x["merge_ts"]), x["topic1"], x["topic2"], x["document_count1"], x["document_count2"]) for x in log.collect()) == sorted(merges) and merges


def test_merging_a_stream_equals_merging_at_once(spark, small):
    from tidemark.plans import bindings, reports

    got = {(r["topic"], str(r["birth"]), r["document_count"]) for r in reports.stream_merge_step(spark, small).collect()}
    registry, _ = merging.merge_all_periods(O.period_topics(bindings.vectors(spark, small)), bindings.SIMILARITY, save)
    assert got == {(r["topic"], str(r["birth"]), r["document_count"]) for r in registry.collect()} and got


@pytest.mark.parametrize("bound", [20_000, 3])
def test_best_match_in_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(O, "BROADCAST_ROWS", bound)
    r = np.random.default_rng(5)
    x, y = r.normal(size=(20, 4)), r.normal(size=(11, 4))
    y[3] = y[7]
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 4)], "a long, u array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)] + [(50, [0.0] * 4)], "b long, w array<double>")
    s = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    got = {q["a"]: q["b"] for q in O.best_match(left, right, "a", "b", "u", "w").collect()}
    assert got == {i: int(np.argmax(np.round(s[i], 12))) for i in range(20)}


def test_representation_stability_takes_the_best_words(spark):
    rows = [(0, "a", [[1.0, 0.0], [0.0, 1.0]]), (0, "b", [[1.0, 0.0], [1.0, 1.0]]), (1, "a", [[1.0, 0.0]])]
    got = {(q["topic"], q["start_ts"]): q["score"] for q in B.representation_stability(spark.createDataFrame(rows, "topic int, ts string, word_vectors array<array<double>>")).collect()}
    assert got == {(0, "a"): pytest.approx(((1 + 0.5**0.5) / 2 + (0.5**0.5 + 0) / 2) / 2), (1, None): 0.0}


def test_sentences_of_the_same_words(spark):
    rows = [(1, 0, "To the sea, the river!"), (1, 1, "the river to the SEA"), (2, 0, "the river"), (3, 5, "sea the to river?"), (4, 0, "..."), (4, 1, None)]
    got = M.word_set_duplicates(spark.createDataFrame(rows, "d long, pos int, sentence string"), "d")
    assert sorted((r["d"], r["pos"], r["class_id"], r["links"]) for r in got.collect()) == [(1, 0, "1:0", 2), (1, 1, "1:0", 2), (3, 5, "1:0", 2)]


def test_embedding_of_paragraphs_in_batches(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(1, 30)], "document_id long, text string")
    got = {r["document_id"]: r["embedding"] for r in M.embed_paragraphs(df, lambda: lambda texts: np.array([[len(t), len(texts)] for t in texts], np.float32), batch=4).collect()}
    assert all(got[i][0] == 5 * i and got[i][1] <= 4 for i in range(1, 30))


def test_numbers_are_gapless_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), "id").repartition(13)
    got = C.number_in_order(df, ["k"]).collect()
    assert all(r["number"] == r["k"] for r in got) and len(got) == 5000


def test_sample_is_the_same_everywhere(spark):
    import hashlib

    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    want = {i for i in range(1000) if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 100 < 20}
    assert {r["doc_id"] for r in C.sample_by_hash(df, "doc_id", 20).collect()} == want and Counter(want)


def test_cv_is_the_cosine_of_context_vectors(spark):
    docs = [(1, "one two three four one five two two six"), (2, "two three six one"), (3, "seven"), (4, "one two one two one two one two one two one two")]
    words = [(0, ["one", "two", "three", "never"]), (1, ["five", "six"]), (2, ["never"])]
    got = {r["topic"]: r["c_v"] for r in O.coherence_cv(spark.createDataFrame(words, "topic int, words array<string>"), spark.createDataFrame(docs, "document_id long, text string"), window=4).collect()}
    windows = [set(w[i:i + 4]) for _, t in docs for w in [t.split()] for i in range(max(1, len(w) - 3))]
    p = lambda *w: sum(set(w) <= x for x in windows) / len(windows)
    for topic, own in words:
        v = np.array([[math.log((p(a, b) + 1e-12) / (p(a) * p(b) + 1e-24)) / -math.log(p(a, b) + 1e-12) if p(a) and p(b) else 0 for b in own] for a in own])
        whole = v.sum(0)
        cosines = [x @ whole / np.linalg.norm(x) / np.linalg.norm(whole) if x.any() else 0 for x in v]
        assert got[topic] == pytest.approx(np.mean(cosines))


def test_texts_with_vectors_are_dealt_by_id(spark, tmp_path):
    """The documents that have a vector all lie in the first file; the cutting of their texts was one task."""
    r = random.Random(1)
    row = lambda i: (i, " ".join(f"w{r.getrandbits(64)}" for _ in range(100)), "en", "s", 9)
    spark.createDataFrame([row(i) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long").repartitionByRange(4, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3, [1.0, 2.0]) for i in range(40)], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "50000"}  # the texts have more
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met = reports._texts(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).select("document_id", "text", "part").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted(r["document_id"] for r in met) == list(range(40)) and len({r["part"] for r in met}) == 4


def test_closest_docs_against_a_plain_version(spark):
    """The counts of the topics come from those of the documents, of words in two topics at least."""
    r = random.Random(3)
    docs = [(i, i % 3, " ".join(r.choices([f"w{k}" for k in range(25)] + [f"only{i % 3}"], k=r.choice([1, 5, 40])))) for i in range(40)]
    terms = {i: Counter(t := text.split()) + Counter(f"{a} {b}" for a, b in zip(t, t[1:])) for i, _, text in docs}
    counts = Counter()
    for i, topic, _ in docs:
        counts.update({(topic, t): n for t, n in terms[i].items()})
    wide = Counter(t for _, t in counts)
    counts = {k: n for k, n in counts.items() if wide[k[1]] >= 2}
    total, every = Counter(), Counter()
    for (topic, t), n in counts.items():
        total[topic] += n
        every[t] += n
    idf = {t: math.log(1 + sum(total.values()) // len(total) / n) for t, n in every.items()}
    score = {(topic, t): math.sqrt(n / total[topic]) * idf[t] for (topic, t), n in counts.items()}
    found = []
    for i, topic, _ in docs:
        own = {t: n * idf[t] for t, n in terms[i].items() if (topic, t) in score}
        if own:
            near = sum(x * score[topic, t] for t, x in own.items()) / math.sqrt(sum(x * x for x in own.values()))
            found.append((topic, -round(near / math.sqrt(sum(s * s for (o, _), s in score.items() if o == topic)), 9), i))
    wanted = [(topic, i, -s) for topic in range(3) for _, s, i in sorted(f for f in found if f[0] == topic)[:4]]
    got = O.closest_docs(spark.createDataFrame(docs, "document_id long, topic int, text string"), 4, []).orderBy("topic", "rank").collect()
    assert [(g["topic"], g["document_id"], round(g["similarity"], 6)) for g in got] == [(t, i, round(s, 6)) for t, i, s in wanted]


def test_words_that_are_cut_are_not_cut_again(spark, monkeypatch):
    """The texts of cluster_metrics are cut once for the topics' words and for their company."""
    docs = spark.createDataFrame([(i, i % 2, f"ab cd {'ef' if i % 3 else 'gh'} ij") for i in range(12)], "document_id long, topic int, text string")
    words = spark.createDataFrame([(0, ["ab", "ef"]), (1, ["cd", "gh"])], "topic int, words array<string>")
    told = lambda d: (sorted(map(tuple, O.coherence(words, d, 2).collect())), sorted(map(tuple, O.term_counts(d, "topic", 2).collect())))
    wanted = told(docs)
    cut = save(docs.select("document_id", "topic", O.T.words(F.col("text")).alias("ws")), "cut")
    monkeypatch.setattr(O.T, "words", None)
    assert told(cut) == wanted and len(wanted[0]) == 2
