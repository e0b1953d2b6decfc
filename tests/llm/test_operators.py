"""Each operator on hard small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, decontaminate, html_text, language_id, ngram_join, pii, registry, sharding, token_counts, warc

DOCS = "doc_id long, text string"
HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "x" * 20_000), (6, "naïve ﬁ İstanbul ΣΑΣ don't 123 <|endoftext|> 😀漢字"), (6, "naïve ﬁ İstanbul ΣΑΣ don't 123 <|endoftext|> 😀漢字"), (None, "no id here"), (7, "a  b\x1cc\u0085d ▁▁ e")]


@pytest.fixture(scope="module")
def hard(spark):
    """A further column has a name that operators use inside."""
    return spark.createDataFrame(HARD, DOCS).withColumn("n", F.lit(1)).withColumn("cid", F.lit("x")).withColumn("base", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_bpe_equals_the_library(spark, hard, empty):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    wanted = []
    for i, t in HARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode_documents(hard, path)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(wanted, key=str)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got.collect())
    assert bpe.encode_documents(empty, path, True).count() == 0


def test_encoding_leaves_the_decoded_text_out(spark, hard):
    """The pipeline needs its digest only: the text isn't handed back, and a step holds few texts at a time."""
    path = registry.tokenizer_path("word_bpe_49k.json")
    got, whole = bpe.encode_documents(hard, path, decoded=False), bpe.encode_documents(hard, path)
    assert got.columns == [c for c in whole.columns if c != "decoded"]
    assert rows(got, *got.columns) == rows(whole, *got.columns)
    assert len(list(bpe.slices(["x" * 100_000] * 20))) == 4


def test_counts_equal_the_library(spark, hard, empty):
    import sentencepiece

    path = registry.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in HARD), key=str)
    assert rows(token_counts.count_tokens(hard, path), "doc_id", "n_bytes", "n_tokens") == wanted
    assert token_counts.count_tokens(empty, path).count() == 0


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for x, (d, _) in zip(label, docs):
        groups[x].append(d)
    least = {x: min((d for d in ds if d is not None), default=None) for x, ds in groups.items()}
    return sorted(((d, len(s), least[x]) for (d, _), s, x in zip(docs, sets, label)), key=str)


@pytest.mark.parametrize("tile", [2048, 3])
def test_join_equals_brute_force(spark, tile, monkeypatch):
    """Chains of edited copies, shared passages, and (with tiny tiles) regions that are cut into tile pairs."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    r = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in r.integers(0, 3000, n)]
    docs, passage = [(i, t) for i, t in HARD if t is None or len(t) < 50], word(30)
    for g in range(6):
        text = word(int(r.integers(20, 120))) + (passage if g % 2 else [])
        for c in range(7):
            docs.append((100 * (g + 1) + c, " ".join(text)))
            text = list(text)
            text[int(r.integers(len(text)))] = f"new{g}{c}"
    docs += docs[-3:] + [(9999, docs[20][1].upper())]
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, DOCS))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_join_of_nothing(empty):
    assert ngram_join.near_duplicates(empty).count() == 0


def test_tile_with_sides():
    a = np.arange(0, 100, dtype=np.int64)
    sets = [a, a[5:], a[:90], np.arange(500, 600, dtype=np.int64)]
    ids = np.arange(4)
    assert len(ngram_join.tile_links(ids, sets)) == 2
    assert {frozenset(x) for x in ngram_join.tile_links(ids, sets, np.array([0, 0, 1, 1]))} <= {frozenset((0, 2)), frozenset((1, 2))}


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(re.sub("[ -]", "", x)) <= 19 and sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(re.sub("[ -]", "", x)[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15)]
PII = ["x@a.b.c_x@d.e mail a.b@c.de, 😀 a@b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 12345", "+1 (017) 555-7713 +33 1 +999999999999999999 4111111111111111", "x" * 5000 + "@" + "y." * 2000 + "z", " ".join(f"p{i}@q.org" for i in range(300))]


def test_base_spans(spark, hard, empty):
    docs = [*HARD, *((50 + i, t) for i, t in enumerate(PII))]
    got = pii.summary(pii.find_spans(spark.createDataFrame(docs, DOCS).withColumn("base", F.lit(1)).withColumn("h", F.lit(2))))
    wanted = []
    for i, t in docs:
        spans = [(k, m.start(), m.end()) for k, p, f in BASE for m in re.finditer(p, t or "") if f(m[0])]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        wanted.append((i, *(sum(k == x for x, _, _ in spans) for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest(), text))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == sorted(wanted, key=str)
    assert pii.find_spans(empty).count() == 0


def test_disclosing_terms_and_sanitising(spark):
    texts = [f"{a} zorblatt wrote from chief@corp.org about {b}." for a, b in (("Yesterday", "apples"), ("Friday", "prices"), ("Later", "weather"), ("Sometimes", "trains"))]
    texts += [f"nothing of {w} here, plain words" for w in ("apples", "prices", "weather", "trains", "stones")] * 20 + ["zorblatt alone"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    found = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    assert "zorblatt" in [s["value"] for s in found[0]["extra"]]
    assert [s["value"] for s in found[len(texts) - 1]["extra"]] == ["zorblatt"] and not found[10]["extra"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(texts) and "chief" not in clean[0] and "[EMAIL]" in clean[0] and "zorblatt" not in clean[0] and clean[10] == texts[10]


def test_decontamination(spark, empty):
    bench = spark.createDataFrame([(1, "A train leaves Boston at 5 pm and travels 120 miles towards Denver before stopping for 30 minutes overnight"), (2, None), (3, ""), (3, "short item"), (4, "12 34 56")], "item_id long, text string")
    same = "Question: a train leaves Boston at 5 pm and travels 120 miles towards Denver before stopping for 30 minutes overnight. Yes."
    moved = "a train leaves Oslo at 7 pm and travels 450 miles towards Madrid before stopping for 20 minutes overnight"
    docs = spark.createDataFrame([(10, same), (11, moved), (11, moved), (12, "A plane leaves at noon and nobody travels anywhere before stopping"), (13, None), (14, ""), (None, same)], DOCS).withColumn("w", F.lit(1)).withColumn("window", F.lit(2))
    assert rows(decontaminate.contaminated(docs, bench), "doc_id", "item_id") == sorted([(10, 1), (11, 1), (None, 1)], key=str)
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_language(spark, empty):
    r = np.random.default_rng(3)
    words = {"aa": ["lorem", "dolor", "amet", "magna"], "bb": ["strygk", "wyxz", "krzyk", "zgrzyt"]}
    docs = [(i, " ".join(r.choice(words[lang], 12)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    docs += [(1000, None, None), (1001, "123 %%%", "aa"), (1002, "", None), (None, "dolor amet magna lorem", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = {r["doc_id"]: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in docs[:200]) and got[None]["lang_pred"] == "aa"
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (1000, 1001, 1002))
    assert not any(got[i]["rejected"] for i in range(200)) and all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df, language_id.fit(empty)).collect()} == {"und"}


def test_model_is_a_distribution():
    rows, _ = language_id.places(["ab ba aab", "bbb a"])
    _, first, inverse = language_id.distinct(rows)
    model = language_id.KneserNey(rows[:, first].T, np.bincount(inverse).astype(float), 4)
    a, b, unseen = ord("a"), ord("b"), ord("z")
    for context in ((0, 0, 0), (0, a, b), (b, a, a), (0, unseen, b)):
        total = np.exp(model.log_probability(np.array([[*context, c] for c in (0, a, b, unseen)], np.uint32))).sum()
        assert total == pytest.approx(1)


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[40:140] = x[7]  # a hot vector
    data = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, []), (None, [1.0] * 8), (920, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("dim", F.lit(1))
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 20, candidate_block=64, query_block=8)
    wanted = []
    for q in range(0, 300, 20):
        score = {i: float((x[i].astype(float) * x[q].astype(float)).sum()) for i in range(300) if i != q}
        wanted += [(q, k, i) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:20], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == sorted(wanted)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_shards(spark, hard, empty):
    docs = spark.createDataFrame([(i, "hot text" if i % 3 == 0 else f"text {i} " + "w " * (i % 50)) for i in range(3000)], DOCS)
    got = sharding.shard_documents(docs, 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.mean() < 1.02 and len(size) == 8
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(c == zlib.crc32(texts[i].encode()) and s == len(texts[i]) + 16 for i, c, s in zip(got["doc_id"], got["text_crc32"], got["size"]))
    assert sharding.shard_documents(hard, 4).count() == len(HARD) and sharding.shard_documents(empty).count() == 0


def test_packing_prefers_free_capacity():
    out = sharding.pack(np.array([[5.0, 5, 1], [5, 5, 1], [1, 1, 1], [1, 1, 1]]), 2)
    assert sorted(out.tolist()) == [0, 0, 1, 1] and out[0] != out[1]


PAGE = "<html><head><title>t</title><script>if(a<b)x('</p>')</script></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div>{}<footer>&copy; me</footer></body></html>"


def test_main_text(spark):
    article = "<article><h1>A &amp; B</h1><p>One\n two<br>three<p>Four <b>five</b></p><aside>no</aside><div id=comments>no</div></article>"
    bare = "<div class=top>Site name</div><div><p>Story {}</p></div><div class=end>All rights</div>"
    pages = [(1, "http://a/1", PAGE.format(article)), (2, "http://a/2", None), (3, "bad url", ""), (4, None, "plain < text"), (5, "http://d/1", PAGE.format("<article>" + "<div>" * 2000 + "deep")),
             *((10 + i, f"http://b/{i}", PAGE.format(bare.format(f"number {i}"))) for i in range(4)), (10, "http://b/0", PAGE.format(bare.format("number 0")))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect())
    want = {1: "A & B\nOne two three\nFour five", 2: "", 3: "", 4: "plain < text", 5: "deep", 10: "Story number 0", 11: "Story number 1", 12: "Story number 2", 13: "Story number 3"}
    assert got == [(i, want[i], len(want[i])) for i in sorted([*want, 10])]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = [(5, "http://a/ü b", "same"), (2, None, "same"), (9, "http://c", None), (8, "x\ny", ""), (1, "u", "p" * 300_000), (None, "v", "same"), (2, "w", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1))
    got = warc.read_archives(warc.write_archives(df)).filter("gap is null").collect()
    first = {"same": 2, "": 8, "p" * 300_000: 1}
    wanted = sorted(((i, u, len(h or ""), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, u, h in pages if i is not None), key=str)
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None), key=str) == wanted
    assert len(got) == len(pages) and all(r["payload_digest"] == warc.payload_digest((dict((p[0], p[2]) for p in pages).get(r["page_id"], "same") or "").encode()) for r in got)
    assert warc.write_archives(df.limit(0)).count() == 0


def test_salvage_skips_damage():
    records = [warc.record_bytes(i, "u", bytes([65 + i]) * 50, warc.payload_digest(bytes([65 + i]) * 50), None) for i in range(4)]
    broken = bytearray(records[1])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + records[0] + bytes(broken) + records[2] + records[3][:-5]
    got = list(warc.salvage(data))
    assert [x[1][0] for x in ((g[0], (g[3][0]["warc-record-id"],)) for g in got if g[0] == "record")] == ["<urn:page:0>", "<urn:page:2>"]
    gaps = [(g[1], g[2]) for g in got if g[0] == "gap"]
    assert gaps[0] == (0, 4) and gaps[1][0] == 4 + len(records[0]) and gaps[-1][1] == len(data)
    plain = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [g[0] for g in warc.salvage(b"WARC/1.1\r\nbroken" + plain)] == ["gap", "record"]


def test_pipeline_on_the_smallest_tables(spark, small):
    """The stages against plain versions of the same decisions."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {r["doc_id"] for r in P.run(spark, small).collect()}
    known = {r["doc_id"] for r in P.keep_known_languages(spark, docs, small).collect()}
    kept = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known]
    firsts = {d for d, _, c in brute_components(kept) if d == c}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert out == {d for d, t in kept if d in firsts and not any(i in plain(t) for i in items)}
