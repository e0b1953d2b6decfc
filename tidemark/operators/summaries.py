"""Extractive summaries: sentences ranked by stationary weights of their cosine graph, inside each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import ranking
from tidemark.operators.written import save

SENTENCE = r"(?<=[.!?])[ \t\n\f\r]+"
DIM = 64
#: Sentences of a document up to which they are ranked in one task.
LONG = 20_000
#: Characters of the documents that are ranked together, and words whose places a task remembers.
PART, KEPT = 200_000, 200_000


def sentences_of(text: Column) -> Column:
    """The sentences of what follows the last double underscore; of three underscores in a row the first two are one."""
    parts = F.split(F.element_at(F.split(text, "__"), -1), SENTENCE)
    # trim would take the place in the array for the characters to trim, were it handed over as it is
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def split_sentences(df: DataFrame, key: str) -> DataFrame:
    """key, pos, sentence of each text."""
    return df.select(key, F.posexplode(sentences_of(F.col("text"))).alias("pos", "sentence"))


def hashed_vector(words: Column, dim: int = DIM) -> Column:
    """A deterministic bag-of-words vector: each word counts in the dimension of its hash."""
    places = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dim)))
    counts = F.aggregate(places, F.array_repeat(F.lit(0.0).cast("float"), dim), lambda v, p: F.transform(v, lambda x, i: F.when(i == p, x + F.lit(1.0).cast("float")).otherwise(x)))
    return counts


def sentence_vectors(sentences: Column, dim: int = DIM, letters: bool = False) -> Column:
    """hashed_vector of the words (or letters) of lower-case sentences, counted in Python so that whole documents stay cheap."""
    @F.pandas_udf("array<float>")
    def count(texts: pd.Series) -> pd.Series:
        import zlib

        places, out = {}, []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in t if letters else t.split(" "):
                if w not in places:
                    places[w] = zlib.crc32(w.encode()) % dim
                v[places[w]] += 1
            out.append(v)
        return pd.Series(out, dtype=object)

    return count(F.lower(sentences))


def embed_paragraphs(df: DataFrame, encoder=None, batch: int = 2048, dim: int = DIM) -> DataFrame:
    """All columns and ``embedding``: the encoder (texts -> matrix), made once a worker, gets batches of texts."""
    schema = df.schema.simpleString()[7:-1] + ", embedding array<float>"

    def run(batches):
        import zlib

        def default(texts):
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    out[i, zlib.crc32(w.encode()) % dim] += 1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        encode = encoder() if encoder else default
        for part in batches:
            for at in range(0, len(part), batch):
                own = part.iloc[at:at + batch]
                yield own.assign(embedding=list(encode(own["text"].tolist())))

    return df.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", embedding array<float>")


def lexrank(similarity: np.ndarray) -> np.ndarray:
    """Stationary weights of the row-normalised similarity graph, for each connected component by its size.

    The graph is symmetric, so what the power method converges to is each row's share of its component's sum.
    """
    n = len(similarity)
    label = np.arange(n)
    linked = similarity > 0
    for _ in range(n):
        new = np.minimum(label, np.where(linked, label, n).min(1))
        if (new == label).all():
            break
        label = new
    return shares(similarity.sum(1), label)


def shares(degree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Each row's share of the sum of its component, times the component's share of the rows."""
    _, own = np.unique(label, return_inverse=True)
    total, size = np.bincount(own, degree), np.bincount(own)
    return np.where(total[own] > 0, degree / np.maximum(total[own], 1e-300), 0.0) * size[own] / max(1, len(degree))


def factored_lexrank(x: np.ndarray) -> np.ndarray:
    """lexrank(x @ x.T) of vectors without a negative number, in memory and time that grow with the rows only.

    Two such rows are similar if they share a dimension, so the components of rows are those of dimensions, and a row's
    sum is its product with the sum of its component; rows of other components add nothing to it.
    """
    used = x > 0
    label = np.arange(x.shape[1])  # of each dimension; a row joins all the dimensions it uses
    together = used.T.astype(np.float32) @ used.astype(np.float32) > 0
    for _ in range(len(label)):
        new = np.minimum(label, np.where(together, label, len(label)).min(1, initial=len(label)))
        if (new == label).all():
            break
        label = new
    some = used.any(1)
    own = np.where(some, label[used.argmax(1)], x.shape[1] + np.arange(len(x)))
    return shares(x @ x.sum(0), own)


def lexrank_summary(sentences: DataFrame, key: str, most: int = 3, share: float = 0.2, second: str | None = None, ratio: float = 0.5) -> DataFrame:
    """key, pos, sentence of each document's summary, in page order. Sentences have ``embedding``; ``second`` names other vectors that are blended in.

    Its size is min(most, n * share) rounded, one at least. The sentences of a document of up to LONG meet in a task, and their
    graph is never written out where no vector holds a negative number. Longer documents are ranked by many tasks.
    """
    columns = [key, "pos", "sentence", "embedding", *([second] if second else [])]
    long = save(sentences.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > LONG), "long_documents")
    if not long.isEmpty():
        rest = lexrank_summary(sentences.join(long, key, "left_anti"), key, most, share, second, ratio)
        return rest.unionByName(_long_summary(sentences.select(*columns).join(long, key), key, most, share, second, ratio))

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.stack(vectors.to_numpy()).astype(float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos").reset_index(drop=True)
        size = max(1, round(min(most, len(df) * share)))
        if len(df) <= size:
            return df[[key, "pos", "sentence"]]
        parts = [(1.0, unit(df["embedding"]))] if not second else [(1 - ratio, unit(df["embedding"])), (ratio, unit(df[second]))]
        if all((x >= 0).all() and w >= 0 for w, x in parts):
            weights = factored_lexrank(np.concatenate([np.sqrt(w) * x for w, x in parts], 1))
        else:
            weights = lexrank(sum(w * np.maximum(x @ x.T, 0) for w, x in parts))
        best = np.sort(np.argsort(-np.round(weights, 12), kind="stable")[:size])
        return df.loc[best, [key, "pos", "sentence"]]

    kind = dict(sentences.dtypes)[key]
    return sentences.select(*columns).groupBy(key).applyInPandas(pick, f"`{key}` {kind}, pos int, sentence string")


def summarise(docs: DataFrame, key: str, most: int = 3, share: float = 0.2, vectors: list[tuple[float, int, bool]] | None = None) -> DataFrame:
    """key, pos, sentence: lexrank_summary of documents that hold their sentences in page order in ``sentences``, where each row stays.

    ``vectors``: share, dimensions and whether letters or words are counted, of each of the vectors that are blended. A document is
    ranked with its row, so neither sentences nor vectors are shuffled. Only documents of more than LONG sentences are spread out.
    """
    vectors = vectors or [(1.0, DIM, False)]
    kind = dict(docs.dtypes)[key]
    ends = F.length("text") - F.length(F.translate("text", ".!?", ""))  # without which sentences needn't be counted
    # a text of fewer characters needs no look at its ends
    long = docs.filter((F.length("text") >= LONG) & (ends >= LONG) & (F.size("sentences") > LONG)).select(key, "sentences", F.monotonically_increasing_id().alias("__row"))
    long = save(long, "long_documents")
    # one use of the sentences, lest they be cut again for each; rows are told apart by size behind it for the same reason
    rows = docs.select(key, F.transform("sentences", lambda t: F.struct(t.alias("said"), F.lower(t).alias("low"))).alias("sentences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vectors)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("sentences")), 0)
            batch = batch.filter(pc.and_(pc.greater(sizes, 0), pc.less_equal(sizes, LONG)))
            if not len(batch):
                continue
            keys, found = batch.column(key), batch.column("sentences").flatten()
            said, low = found.field("said"), found.field("low")
            ends = np.cumsum([0, *pc.list_value_length(batch.column("sentences")).to_pylist()])
            letters = np.cumsum([0, *pc.utf8_length(low).to_pylist()])[ends]
            for part in runs(np.diff(letters), PART):
                own = ends[part.start:part.stop + 1]
                x = count(low.slice(own[0], own[-1] - own[0]))
                best = [best_rows(x[a:b], max(1, round(min(most, (b - a) * share)))) for a, b in zip(own - own[0], own[1:] - own[0])]
                at = np.concatenate([a + k for a, k in zip(own, best)])
                of = np.repeat(np.arange(part.start, part.stop), [len(k) for k in best])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(np.concatenate(best), pa.int32()), said.take(pa.array(at))], [key, "pos", "sentence"])

    told = rows.mapInArrow(run, f"`{key}` {kind}, pos int, sentence string")
    if long.isEmpty():
        return told
    apart = long.select("__row", F.posexplode("sentences").alias("pos", "sentence"))
    apart = apart.withColumns({f"v{i}": sentence_vectors(F.col("sentence"), dim, letters) for i, (_, dim, letters) in enumerate(vectors)}).withColumnRenamed("v0", "embedding")
    rest = lexrank_summary(apart, "__row", most, share, *(("v1", vectors[1][0]) if len(vectors) > 1 else ()))
    return told.unionByName(rest.join(long.select("__row", key), "__row").select(key, "pos", "sentence"))


def runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours of about ``most`` in all, one at least."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def best_rows(x: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` rows with the largest weights, in order."""
    if len(x) <= size:
        return np.arange(len(x))
    return np.sort(np.argsort(-np.round(factored_lexrank(x), 12), kind="stable")[:size])


class Counter:
    """The blended vectors of many lower-case sentences at once: those of sentence_vectors at unit length, times the root of their share."""

    def __init__(self, vectors: list[tuple[float, int, bool]]):
        self.vectors, self.places = vectors, [{} for _ in vectors]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        told, out = texts.to_pylist(), []
        for (weight, dim, letters), places in zip(self.vectors, self.places):
            if len(places) > KEPT:
                places.clear()
            if letters:
                units = np.frombuffer("".join(told).encode("utf-32-le"), np.uint32)
                own, at = np.unique(units, return_inverse=True)
                place, sizes = np.array([zlib.crc32(chr(c).encode()) % dim for c in own], np.int64)[at], [len(t) for t in told]
            else:
                units = [t.split(" ") for t in told]
                for w in {w for u in units for w in u}.difference(places):
                    places[w] = zlib.crc32(w.encode()) % dim
                place, sizes = np.array([places[w] for u in units for w in u], np.int64), [len(u) for u in units]
            x = np.bincount(np.repeat(np.arange(len(told)), sizes) * dim + place, minlength=len(told) * dim).reshape(-1, dim)
            out.append(np.sqrt(weight) * (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))
        return np.concatenate(out, 1)


def word_set_duplicates(sentences: DataFrame, key: str) -> DataFrame:
    """key, pos, class_id, links: sentences of the same set of words, whatever their order, case and punctuation (paraphrases
    by reordering). ``class_id`` is the smallest key:pos of its class, ``links`` how many others it has; no pairs are listed.

    Sentences without a word are in no class. Exact: classes are told by a digest of the sorted words.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    told = sentences.select(key, "pos", F.when(F.size(words) > 0, F.sha2(F.array_join(words, " "), 256)).alias("digest")).filter("digest is not null")
    classes = told.groupBy("digest").agg(F.min(F.struct(F.col(key), F.col("pos"))).alias("first"), F.count("*").alias("n"))
    named = classes.filter("n > 1").select("digest", F.concat_ws(":", f"first.{key}", "first.pos").alias("class_id"), (F.col("n") - 1).alias("links"))
    return told.join(named, "digest").select(key, "pos", "class_id", "links")


def _long_summary(sentences: DataFrame, key: str, most: int, share: float, second: str | None, ratio: float) -> DataFrame:
    """The same for long documents; ``__n`` holds their number of sentences."""
    names, shares = (["embedding"], [1.0]) if not second else (["embedding", second], [1 - ratio, ratio])

    def times(v: Column | str, factor: Column) -> Column:
        return F.transform(v, lambda x: x * factor)

    rows = sentences.select(key, "pos", "sentence", "__n", *(F.col(c).cast("array<double>").alias(f"v{i}") for i, c in enumerate(names)))
    rows = rows.withColumns({f"n{i}": 1 / F.greatest(V.norm(F.col(f"v{i}")), F.lit(1e-12)) for i in range(len(names))})
    rows = save(rows.select(key, "pos", "sentence", "__n", *(times(f"v{i}", F.col(f"n{i}")).alias(f"u{i}") for i in range(len(names)))), "long_sentences")
    below = F.lit(False)
    for i in range(len(names)):
        below = below | F.exists(f"u{i}", lambda x: x < 0)
    signed = rows.filter(below).select(key).distinct()
    scaled = F.concat(*(times(f"u{i}", F.lit(float(np.sqrt(w)))) for i, w in enumerate(shares)))
    weights = ranking.factored_weights(rows.join(signed, key, "left_anti").select(key, "pos", scaled.alias("v")), key)
    if not signed.isEmpty():
        own = rows.join(signed, key, "left_semi")
        spans = [int(own.select(F.max(F.size(f"u{i}"))).first()[0]) for i in range(len(names))]
        weights = weights.unionByName(ranking.block_weights(own.select(key, "pos", F.concat(*(f"u{i}" for i in range(len(names)))).alias("v")), key, spans, shares))
    size = F.greatest(F.lit(1), F.rint(F.least(F.lit(float(most)), F.col("__n") * share)))
    best = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 12)), "pos")
    told = weights.withColumn("__k", F.row_number().over(best)).filter(F.col("__k") <= most)
    return rows.join(told, [key, "pos"]).filter(F.col("__k") <= size).select(key, "pos", "sentence")


def mmr(candidates: DataFrame, key: str, k: int = 5, diversity: float = 0.3) -> DataFrame:
    """key, rank, word: words chosen one by one for relevance to the topic's vector and distance from those chosen.

    ``candidates``: key, word, embedding, centroid; a topic has a few dozen of them.
    """
    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("word").reset_index(drop=True)
        x = np.stack(df["embedding"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = np.asarray(df["centroid"].iloc[0], float)
        near, own = x @ (c / max(np.linalg.norm(c), 1e-12)), x @ x.T
        chosen = [int(np.argmax(near))]
        while len(chosen) < min(k, len(df)):
            value = (1 - diversity) * near - diversity * own[:, chosen].max(1)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
        return pd.DataFrame({key: df[key].iloc[0], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32), "word": df["word"].iloc[chosen].to_numpy()})

    return candidates.groupBy(key).applyInPandas(pick, f"`{key}` {dict(candidates.dtypes)[key]}, rank int, word string")
