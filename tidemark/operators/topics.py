"""Topics of a period: counts, centroids, words, assignment, representative documents, diversity and coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T, vectors as V
from tidemark.operators.joins import join_counted
from tidemark.operators.written import save

#: Rows of a matching's right side up to which they are broadcast (after counting them).
BROADCAST_ROWS = 20_000


def topic_info(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per period and topic: rows, distinct documents and sorted distinct sources (sites), in one aggregation."""
    return rows.groupBy(*(keys or ["period", "topic"])).agg(
        F.count("*").alias("count"), F.countDistinct("document_id").alias("document_count"),
        F.sort_array(F.collect_set("source")).alias("sources"))


def topic_urls(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The urls of each period and topic, a row each, as there may be one for each document."""
    return rows.select(*(keys or ["period", "topic"]), "url").distinct()


def period_topics(rows: DataFrame) -> DataFrame:
    """Topic frame for merging: info and centroid of each topic but the outliers."""
    rows = rows.filter("topic != -1")
    return topic_info(rows).join(V.mean_vector(rows, ["period", "topic"], "embedding", "embedding").drop("n"), ["period", "topic"])


def words_of(docs: DataFrame) -> Column:
    """The words of each text, from ``ws`` where they are cut already."""
    return F.col("ws") if "ws" in docs.columns else T.words(F.col("text"))


def term_counts(docs: DataFrame, topic: str, min_df: int = 2, stop_words: list[str] | None = None, pairs: bool = True) -> DataFrame:
    """topic, term, n for words and word pairs that occur in at least ``min_df`` topics."""
    tokens = words_of(docs)
    terms = T.ngrams(tokens, stop_words or []) if pairs else F.filter(tokens, lambda w: ~w.isin(*(stop_words or [""])))
    return in_topics(docs.select(topic, F.explode(terms).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("n")), min_df).drop("topics")


def in_topics(counted: DataFrame, min_df: int) -> DataFrame:
    """The rows of ``counted`` (a row for each topic and term) whose term occurs in at least ``min_df`` topics, with ``topics``, their number."""
    # a term has as many rows as it has topics, however often it occurs
    return counted.withColumn("topics", F.count("*").over(Window.partitionBy("term"))).filter(F.col("topics") >= min_df)


def class_tfidf(counts: DataFrame, topic: str, reduce_frequent: bool = True) -> DataFrame:
    """topic, term, score: share of the term in its topic (its root, if asked) times ln(1 + A / f) with A the mean number of words of
    a topic, cut to a whole number, and f the term's count in all topics."""
    counts = save(counts.withColumn("__f", F.sum("n").over(Window.partitionBy("term"))), "term_counts")  # a row for each topic of a term
    total = counts.groupBy(topic).agg(F.sum("n").alias("__w"))
    mean = total.agg(F.floor(F.avg("__w")).alias("__a"))
    share = F.col("n") / F.col("__w")
    scored = counts.join(total, topic).withColumn("tf", F.sqrt(share) if reduce_frequent else share).crossJoin(F.broadcast(mean))
    return scored.select(topic, "term", (F.col("tf") * F.log(1 + F.col("__a") / F.col("__f"))).alias("score"))


def top_words(scores: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """keys, words (best first, ties by term) and name: the topic with its four best words."""
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= k)
    listed = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words"))
    return listed.withColumn("name", F.concat_ws("_", F.col(keys[-1]).cast("string"), F.array_join(F.slice("words", 1, 4), "_")))


def best_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, a: str, b: str) -> DataFrame:
    """For each left row the right row of highest cosine (ties: smallest right_key): left_key, right_key, similarity.

    The right side holds topics. It is written once and broadcast if it is small; else left rows meet its blocks of BROADCAST_ROWS one by one.
    Norms are taken once a row, and the best pair is found by map-side aggregation, so no pair list is kept.
    """
    near = save(right.select(right_key, F.col(b).alias("__b"), V.norm(F.col(b)).alias("__m")).filter("__m > 0"), "right_side")
    own = left.select(left_key, F.col(a).alias("__a"), V.norm(F.col(a)).alias("__n")).filter("__n > 0")
    n = near.count()
    if n <= BROADCAST_ROWS:
        pairs = own.crossJoin(F.broadcast(near))
    else:
        blocks = -(-n // BROADCAST_ROWS)
        near = near.withColumn("__k", F.pmod(F.xxhash64(right_key), F.lit(blocks)))
        pairs = own.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(near, "__k")
    scored = pairs.select(left_key, right_key, (V.dot(F.col("__a"), F.col("__b")) / (F.col("__n") * F.col("__m"))).alias("similarity")).filter("similarity is not null")
    best = scored.groupBy(left_key).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(right_key).alias("k"))).alias("best"))
    return best.select(left_key, F.col("best.k").alias(right_key), (-F.col("best.s")).alias("similarity"))


def assign_zero_shot(docs: DataFrame, named: DataFrame, minimum: float) -> DataFrame:
    """document_id, name, similarity; the name is null under the minimum."""
    got = best_match(docs, named, "document_id", "name", "embedding", "centroid")
    return got.withColumn("name", F.when(F.col("similarity") >= minimum, F.col("name")))


def reduce_outliers(doc_terms: DataFrame, scores: DataFrame) -> DataFrame:
    """document_id, topic, score: the topic whose term scores are closest in cosine to the document's term counts, if over 0."""
    length = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("__l"))
    own = doc_terms.groupBy("document_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("__d"))
    met = doc_terms.join(scores, "term").groupBy("document_id", "topic").agg(F.sum(F.col("n") * F.col("score")).alias("__p"))
    near = met.join(length, "topic").join(own, "document_id").select("document_id", "topic", (F.col("__p") / (F.col("__l") * F.col("__d"))).alias("score")).filter("score > 0")
    best = near.groupBy("document_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "topic")).alias("b"))
    return best.select("document_id", F.col("b.topic").alias("topic"), (-F.col("b.s")).alias("score"))


def closest_docs(docs: DataFrame, k: int, stop_words: list[str], min_df: int = 2) -> DataFrame:
    """topic, document_id, similarity, rank: the k documents of each topic whose words, weighted by rarity, have the highest cosine with
    the topic's class-based TF-IDF, of the terms in at least ``min_df`` topics. ``docs``: document_id, topic, text.

    Texts are cut once: the topics' counts are those of their documents added up, and a term's count in all topics stands beside each of its rows."""
    own = save(docs.select("document_id", "topic", F.explode(T.ngrams(T.words(F.col("text")), stop_words)).alias("term")).groupBy("document_id", "topic", "term").agg(F.count("*").alias("n")), "document_terms")
    counted = own.groupBy("topic", "term").agg(F.sum("n").alias("c"), F.count("*").alias("rows"))
    counts = save(in_topics(counted, min_df).withColumn("__f", F.sum("c").over(Window.partitionBy("term"))).drop("topics"), "counts")
    words = counts.groupBy("topic").agg(F.sum("c").alias("__w"))
    idf = F.log(1 + F.col("__a") / F.col("__f"))
    values = counts.join(words, "topic").crossJoin(F.broadcast(words.agg(F.floor(F.avg("__w")).alias("__a"))))
    values = save(values.select("topic", "term", "rows", idf.alias("idf"), (F.sqrt(F.col("c") / F.col("__w")) * idf).alias("score")), "values")
    scores = values.select("topic", "score")
    met = join_counted(own, values, ["topic", "term"], "rows", own.count())
    weight = F.col("n") * F.col("idf")
    length = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("__l"))
    sums = met.groupBy("document_id", "topic").agg(F.sum(weight * F.col("score")).alias("p"), F.sqrt(F.sum(weight * weight)).alias("d"))
    near = sums.join(F.broadcast(length), "topic").select("topic", "document_id", F.round(F.col("p") / (F.col("d") * F.col("__l")), 9).alias("similarity"))
    return top_per_group(near, ["topic"], [F.desc("similarity"), "document_id"], k)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def unique_word_share(words: DataFrame, k: int) -> DataFrame:
    """Distinct words among the first k of each topic, over k times the topics."""
    rows = words.select(F.explode(F.slice("words", 1, k)).alias("w"))
    return rows.agg(F.countDistinct("w").alias("distinct")).crossJoin(words.agg(F.count("*").alias("topics"))).select((F.col("distinct") / (F.lit(k) * F.col("topics"))).alias("unique_share"))


def jaccard_diversity(words: DataFrame, k: int) -> DataFrame:
    """Mean Jaccard distance between the first k words of two topics, over all pairs; null for one topic."""
    a = words.select(F.col("topic").alias("t1"), F.slice("words", 1, k).alias("w1"))
    b = words.select(F.col("topic").alias("t2"), F.slice("words", 1, k).alias("w2"))
    pairs = a.join(b, F.col("t1") < F.col("t2"))
    return pairs.agg(F.avg(1 - F.size(F.array_intersect("w1", "w2")) / F.size(F.array_union("w1", "w2"))).alias("diversity"))


def _covered(places: DataFrame, keys: list[str], window: int) -> Column:
    """Windows that begin with or before a place and hold it, but hold no earlier place of the same keys and document.

    A window is known by its first place; the sum over all places counts each window that holds any of them once."""
    before = F.lag("pos").over(Window.partitionBy(*keys, "document_id").orderBy("pos"))
    first = F.greatest(F.col("pos") - window + 1, F.lit(0), F.when(before.isNotNull(), F.least(before, F.col("last")) + 1))
    return F.greatest(F.least(F.col("pos"), F.col("last")) - first + 1, F.lit(0))


def cooccurrence(words: DataFrame, docs: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How often the topics' first k words come, alone and in pairs, from one written table of their places.

    (a, b, n_ab, d_ab) for a < b and for a = b, in windows and in documents; (windows, docs) of all texts; the pairs of each topic
    (topic, i, j, x, y). A window that holds both words of a pair is one that holds either, counted from merged places, subtracted from
    the sum of both, so no window is ever written out; the few pairs asked for meet the places by broadcast.
    """
    listed = words.select("topic", F.slice("words", 1, k).alias("ws"))
    pairs = listed.select("topic", "ws", F.posexplode("ws").alias("i", "x")).select("topic", "i", "x", F.posexplode("ws").alias("j", "y"))
    asked = save(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    # written, as Spark else cuts each text of the table, those without topic too, to drop empty ones before the join
    tokens = docs if "ws" in docs.columns else save(docs.select("document_id", words_of(docs).alias("ws")), "tokens")
    sizes = tokens.agg(F.sum(F.greatest(F.size("ws") - window + 1, F.lit(1))).alias("windows"), F.count("*").alias("docs"))
    rows = tokens.select("document_id", F.greatest(F.size("ws") - window, F.lit(0)).alias("last"), F.posexplode("ws").alias("pos", "w"))
    wanted = asked.select(F.col("a").alias("w")).union(asked.select("b")).distinct()
    places = save(rows.join(F.broadcast(wanted), "w", "left_semi"), "places")  # at most k words a topic
    single = save(places.withColumn("c", _covered(places, ["w"], window)).groupBy("w", "document_id").agg(F.sum("c").alias("c")).groupBy("w").agg(F.sum("c").alias("n"), F.count("*").alias("d")), "single")
    real = F.broadcast(asked.filter("a != b"))  # at most k * k pairs a topic
    either = places.join(real, places["w"] == real["a"]).unionByName(places.join(real, places["w"] == real["b"]))
    met = either.withColumn("c", _covered(either, ["a", "b"], window)).groupBy("a", "b", "document_id").agg(F.sum("c").alias("c"), F.max((F.col("w") == F.col("a")).cast("int")).alias("has_a"), F.max((F.col("w") == F.col("b")).cast("int")).alias("has_b"))
    union = met.groupBy("a", "b").agg(F.sum("c").alias("u"), F.sum(F.col("has_a") * F.col("has_b")).alias("d_ab"))
    of = lambda c: single.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}"))
    both = union.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b") - F.col("u")).alias("n_ab"), "d_ab")
    # a pair of which one word never occurs has no row
    both = both.unionByName(single.select(F.col("w").alias("a"), F.col("w").alias("b"), F.col("n").alias("n_ab"), F.col("d").alias("d_ab")))
    return save(both, "cooccurrence"), sizes, pairs


def _measured(words: DataFrame, docs: DataFrame, window: int, k: int) -> DataFrame:
    """topic, i, j and the counts of each ordered pair of the topic's words: n_xy, n_x, n_y, d_xy, d_y, windows."""
    both, sizes, pairs = cooccurrence(words, docs, window, k)
    keyed = pairs.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(both, ["a", "b"], "left")
    of = lambda c: both.filter("a = b").select(F.col("a").alias(c), F.col("n_ab").alias(f"n_{c}"), F.col("d_ab").alias(f"d_{c}"))
    met = keyed.join(of("x"), "x", "left").join(of("y"), "y", "left").crossJoin(F.broadcast(sizes))
    zero = F.lit(0)
    return met.select("topic", "i", "j", "windows", F.coalesce("n_ab", zero).alias("n_xy"), F.coalesce("n_x", zero).alias("n_x"), F.coalesce("n_y", zero).alias("n_y"), F.coalesce("d_ab", zero).alias("d_xy"), F.coalesce("d_y", zero).alias("d_y"))


EPS = 1e-12


def _pmi() -> tuple[Column, Column]:
    """Pointwise mutual information and its normalised form."""
    p = F.col("n_xy") / F.col("windows")
    pmi = F.log((p + EPS) / (F.col("n_x") / F.col("windows") * F.col("n_y") / F.col("windows") + EPS * EPS))
    return pmi, pmi / -F.log(p + EPS)


def coherence(words: DataFrame, docs: DataFrame, window: int = 10, k: int = 10) -> DataFrame:
    """topic, c_npmi, c_uci: mean over the pairs of its words of (normalised) pointwise mutual information in sliding
    windows, and u_mass from documents."""
    pmi, npmi = _pmi()
    mass = F.log((F.col("d_xy") + 1) / F.greatest("d_y", F.lit(1)))
    return _measured(words, docs, window, k).filter("j < i").groupBy("topic").agg(F.avg(npmi).alias("c_npmi"), F.avg(pmi).alias("c_uci"), F.avg(mass).alias("u_mass"))


def coherence_cv(words: DataFrame, docs: DataFrame, window: int = 110, k: int = 10) -> DataFrame:
    """topic, c_v: each word's vector of normalised mutual information with all words of the topic, its cosine with the sum of
    these vectors, and the mean of the cosines. Words that never occur have vectors of zeros and cosines of 0."""
    npmi = F.when((F.col("n_x") > 0) & (F.col("n_y") > 0), _pmi()[1]).otherwise(0.0)
    cells = _measured(words, docs, window, k).select("topic", "i", "j", npmi.alias("v"))
    whole = F.sum("v").over(Window.partitionBy("topic", "j"))  # as many rows as a topic has words
    sides = cells.withColumn("s", whole).groupBy("topic", "i").agg(F.sum(F.col("v") * F.col("s")).alias("p"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return sides.groupBy("topic").agg(F.avg(F.coalesce(F.try_divide(F.col("p"), F.sqrt(F.col("vv") * F.col("ss"))), F.lit(0.0))).alias("c_v"))
