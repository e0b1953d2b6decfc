"""Paraphrases: all pairs of sentences whose word vectors have a cosine of a threshold or more, by an inverted index.

A sentence's vector counts its words. Sentences with equal vectors are one class, and only classes are compared. The dimensions
of a vector are sorted from the rarest word on. Let the rest of a vector behind a place be shorter than the threshold times the
whole: then two vectors whose only common words lie in such a rest (of the one whose rest begins at the rarer word) have a
smaller cosine, as the other is no longer than its length. So a vector is indexed by its words before that place alone, and similar vectors
have an indexed word in common.

Words that more than ``HOT`` classes are indexed by would bring too many together. There a second word is asked for: the rest is taken
behind a later place, where it stays below the threshold even with the hot word's own share added, and both vectors must have
the same next common word before that place. Vectors that are nearly the hot word alone meet each other only. Lists that are long even so are
cut into tiles, and pairs of tiles are dealt out, so that no task holds a list.

The index holds no vectors, only a class's number, squared length, what is left of it, how many words it has, these as 128 bits, and how its length is dealt over 16 groups
of them: what one side has left, how many words it holds alone and what both have in each group bound the cosine from above. Without the groups a short sentence met every
long one, whose bits are all set, so candidates grew with the square of the input. The pairs that the bounds leave are compared by their words, so the result
is exact: no pair is lost, none is listed twice.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.written import save

#: Classes with a word before it counts as hot, and rows of a tile of a longer list. A second word nearly doubles the postings, so one task compares what it can.
HOT, LONG = 16_384, 8192
#: A word.
WORD = r"[\p{L}\p{N}]+"
#: A word's number is known from this share of all words on.
COMMON = 1_000_000
#: Rows of a list from which on it is compared in blocks, rows of a block, and pairs that are looked at together.
DENSE, BLOCK, SOME = 64, 96, 50_000
#: Texts whose word counts a task remembers.
KEPT = 2000
#: A class with this share of all sentences is large; there are as many at most.
SPREAD = 200
#: Numbers of classes that are sent to all tasks at most (16 MB).
SENT = 1_000_000
#: Bits of the table that tells which keys may be among others (16 MB), and of the pieces that it is put together from.
BITS, PIECE = 1 << 27, 1 << 16
#: What a posting tells of its class.
OF_CLASS = ["n2", "d", "b0", "b1", "e0", "e1"]


def words_of(sentence: Column) -> Column:
    """The words of a sentence, sorted and joined by blanks, as no word holds one; empty without words."""
    return F.array_join(F.sort_array(F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0))), " ")


def with_words(sentences: DataFrame) -> DataFrame:
    """The sentences that have a word; asked of the words themselves, Spark would cut each sentence twice."""
    return sentences.filter(F.lower("sentence").rlike(WORD))


def classes(sentences: DataFrame, key: str) -> DataFrame:
    """id, first (smallest key and pos), n, words (joined) of each set of sentences with equal word counts; sentences without words are in none."""
    told = with_words(sentences).select(F.struct(F.col(key).alias("key"), F.col("pos").cast("long").alias("pos")).alias("at"), words_of(F.col("sentence")).alias("words"))
    return told.groupBy("words").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())


def members(sentences: DataFrame, key: str) -> DataFrame:
    """key, pos, cid (a digest of the words) of each sentence with words."""
    return with_words(sentences).select(key, F.col("pos").cast("int").alias("pos"), F.unhex(F.md5(words_of(F.col("sentence")))).alias("cid"))


def place_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def spotted(keys: DataFrame) -> np.ndarray:
    """A bit at the place of each key (the only column), as a table of bytes; it is put together by pieces and has one size, however many keys there are."""
    def put(own: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(PIECE, bool)
        bits[own["bit"]] = True
        return pd.DataFrame({"piece": [own["piece"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    place = keys.select(place_of(keys.columns[0]).alias("place"))
    parts = place.select(F.floor(F.col("place") / PIECE).cast("int").alias("piece"), (F.col("place") % PIECE).cast("int").alias("bit"))
    table = np.zeros((BITS // PIECE, PIECE // 8), np.uint8)
    for r in parts.groupBy("piece").applyInPandas(put, "piece int, bits binary").collect():
        table[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def among(key: str, table: np.ndarray) -> Column:
    """Whether a key may be one of those of the table: true for all of these and for few others."""
    def asked(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series(table[at >> 3] & (128 >> (at & 7)) > 0)

    # called so, it stays where it is: moved below, the key would be worked out for it and then once more
    return F.pandas_udf(asked, "boolean").asNondeterministic()(place_of(key))


def vectors(told: DataFrame) -> DataFrame:
    """id, codes: a hash of each word of a class, repeats included."""
    return told.select("id", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("codes"))


class Index:
    """What a class must share with any similar one, for many classes at once; ``known`` and ``times``: how often the common words come,
    ``hot``: words before whose places too many classes meet."""

    def __init__(self, percent: int, known: np.ndarray, times: np.ndarray, hot: np.ndarray):
        self.percent, self.known, self.times, self.hot = percent, known, times, hot

    def __call__(self, codes: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        """row, code, second, share, of each posting, and n2, d, b0, b1, e0, e1 (squared length, words, words as bits, length by group of bits) of each row."""
        own, at = np.unique(codes, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        often = np.where(self.known[place] == own, self.times[place], 0) if len(self.known) else np.zeros(len(own), np.int64)
        order = np.argsort(often, kind="stable")  # ties by code
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        own = own[order]
        # the dimensions of each row, rarest first
        keys, c = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(own) + rank[at], return_counts=True)
        row, word = np.divmod(keys, len(own))
        code, first = own[word], np.searchsorted(row, np.arange(len(sizes)))
        last = np.append(first[1:], len(row))[row]
        upto = np.append(0, np.cumsum(c * c))
        n2 = np.add.reduceat(c * c, first)
        rest = upto[last] - upto[:-1]
        need = -(-self.percent**2 * n2 // 10_000)[row]
        bit = np.uint64(1) << (code & 63).astype(np.uint64)
        low = (code & 64) == 0
        b0, b1 = (np.bitwise_or.reduceat(np.where(x, bit, np.uint64(0)), first).view(np.int64) for x in (low, ~low))
        # the root of each group's share of the length, rounded up to a byte; zeros where the bits tell nearly as much
        group = np.bincount(row * 16 + ((code & 127) >> 3), c * c, len(sizes) * 16).reshape(-1, 16)
        root = np.ceil(255 * np.sqrt(group / n2[:, None])).astype(np.uint8)
        root[8 * (n2 - np.bitwise_count(b0.view(np.uint64)) - np.bitwise_count(b1.view(np.uint64))) <= n2] = 0
        e0, e1 = root.view(np.int64).T
        inside = np.flatnonzero(rest >= need)
        hot = np.isin(code[inside], self.hot)
        i = inside[hot]
        # the words behind a hot one whose rest, with the hot word's share, isn't too short; the rest falls from place to place
        wide = int(n2.max()) + 1
        stop = np.searchsorted(row * wide + (wide - 1 - rest), row[i] * wide + (wide - 1 - np.maximum(need[i] - c[i] * c[i], 1)), side="right")
        more = np.maximum(stop - i - 1, 0)
        w = np.repeat(i, more)
        s = np.arange(len(w)) - np.repeat(np.cumsum(more) - more, more) + w + 1
        single = np.concatenate([inside[~hot], i[c[i] * c[i] >= need[i]]])
        mass = np.concatenate([rest[inside[~hot]], (c * c)[single[len(inside) - len(i):]], (c * c)[w] + rest[s]])
        place = np.concatenate([single, w])
        return {"row": row[place], "code": code[place], "second": np.concatenate([np.zeros(len(single), np.int64), code[s]]),
                "share": mass / n2[row[place]], "n2": n2, "d": last[first] - first, "b0": b0, "b1": b1, "e0": e0, "e1": e1, "inside": code[inside]}


def lists(rows: DataFrame, make: Index, columns: str, pick: Callable) -> DataFrame:
    """What ``pick`` takes from the index of each batch of ``rows`` (id, codes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = batch.column("codes")
                told = make(codes.flatten().to_numpy(), pc.list_value_length(codes).to_numpy())
                yield pa.RecordBatch.from_pydict(pick(batch.column("id").to_numpy(), told))

    return rows.mapInArrow(run, columns)


def counted(names: list[str], told: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """How often each value, or pair of values, comes."""
    own, n = np.unique(np.stack([told[c] for c in names], 1), axis=0, return_counts=True) if len(names) > 1 else np.unique(told[names[0]], return_counts=True)
    return {c: x for c, x in zip(names, own.reshape(-1, len(names)).T)} | {"n": n}


def index_of(rows: DataFrame, percent: int) -> Index:
    """The order of words, and those that are hot. Words with a share of 1/COMMON of all are told by their number, of which there are COMMON
    at most; rarer ones go by their code alone, before them. Any order gives the same pairs."""
    words = save(rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    common = words.filter(F.col("n") * COMMON >= F.lit(total)).toPandas().sort_values("code")
    make = Index(percent, common["code"].to_numpy(np.int64), common["n"].to_numpy(np.int64), np.zeros(0, np.int64))
    met = lists(rows, make, "code long, n long", lambda ids, told: counted(["code"], {"code": told["inside"]}))
    hot = met.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).select("code").toPandas()
    make.hot = np.sort(hot["code"].to_numpy(np.int64))
    return make


def postings(rows: DataFrame, percent: int, make: Index | None = None) -> DataFrame:
    """The index: code, second (0: none), id, share and OF_CLASS; a class is listed under what it must share with any similar one.

    ``share``: how much of the squared length is left, if what it is listed under are its first common words with another class."""
    def pick(ids: np.ndarray, told: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        row = told["row"]
        return {"code": told["code"], "second": told["second"], "id": ids[row], "share": told["share"].astype(np.float32)} | {c: told[c][row] for c in OF_CLASS}

    return lists(rows, make or index_of(rows, percent), "code long, second long, id long, share float, " + ", ".join(f"{c} long" for c in OF_CLASS), pick)


def tiled(rows: DataFrame, percent: int) -> DataFrame:
    """The postings, each under the ``list`` of whose rows it is compared: one, or with ``side`` 1 or 2 one for each pair of tiles."""
    make = index_of(rows, percent)
    index = postings(rows, percent, make).withColumn("list", F.xxhash64("code", "second")).withColumn("side", F.lit(0))
    rest = ["id", "share", *OF_CLASS]
    if not len(make.hot):
        return index.select("list", "side", *rest)
    # without hot words no list is longer than HOT
    def pick(ids: np.ndarray, told: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        own = np.isin(told["code"], make.hot)
        return counted(["code", "second"], {"code": told["code"][own], "second": told["second"][own]})

    sizes = lists(rows, make, "code long, second long, n long", pick).groupBy("code", "second").agg(F.sum("n").alias("n"))
    sizes = save(sizes.filter(F.col("n") > max(LONG, HOT)).withColumn("tiles", F.ceil(F.col("n") / LONG)), "long_lists")
    if sizes.isEmpty():
        return index.select("list", "side", *rest)
    told = index.join(F.broadcast(sizes.select("code", "second", "tiles")), ["code", "second"], "left")
    own = F.pmod(F.xxhash64("id"), F.col("tiles"))
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    wide = told.withColumn("tile", own).withColumn("other", other)
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    side = F.when(F.col("tiles").isNull() | (F.col("tile") == F.col("other")), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2)
    return wide.select(F.when(F.col("tiles").isNull(), F.col("list")).otherwise(F.xxhash64("list", low, high)).alias("list"), side.alias("side"), *rest)


def by_group(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each class in 16 groups, and what each group's words have of the squared length at most."""
    bits, root = (np.stack([x[f"{c}0"], x[f"{c}1"]], 1).view(np.uint8) for c in "be")
    set_bits = np.bitwise_count(bits).astype(np.int64)
    # a bit stands for 1 at least, so a group has what the bits of the others leave
    told = np.where(bits > 0, set_bits + (x["n2"] - set_bits.sum(1))[:, None], 0) / x["n2"][:, None]
    return bits, np.where(root.any(1)[:, None], (root / 255.0) ** 2, told)


def met_in(x: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """All that ``met_parts`` finds."""
    found = list(met_parts(x, least))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def met_parts(x: dict[str, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each list (sorted by list) that may be similar by their shares, by the words that one alone holds, and by what both have in each group.

    Within a list classes are sorted by their number of words, so that each meets a stretch of the list: those that have so few words less that the rest of its own
    leaves enough of its length. Lists of DENSE rows are compared as blocks of rows by columns, the shorter ones side by side."""
    order = np.lexsort((-x["d"], x["list"]))
    x = {c: v[order] for c, v in x.items()}
    bits, held = by_group(x)

    def left(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What the words of p may have in each group without those that q doesn't hold."""
        return np.maximum(held[p] - np.bitwise_count(bits[p] & ~bits[q]) / x["n2"][p, None], 0)

    def alone(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x["b0"][p] & ~x["b0"][q]).astype(np.int64) + np.bitwise_count(x["b1"][p] & ~x["b1"][q])

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return 1 - np.maximum(alone(p, q), x["d"][p] - x["d"][q]) / x["n2"][p]

    def told(t: np.ndarray, u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(t), SOME):
            a, b = t[i:i + SOME], u[i:i + SOME]
            side = x["side"][a] + x["side"][b]
            near = (x["share"][a] * x["share"][b] >= least) & ((side == 3) | (side == 0)) & (x["id"][a] != x["id"][b])
            a, b = a[near], b[near]
            near = apart(a, b) * apart(b, a) >= least
            a, b = a[near], b[near]
            near = np.sqrt(left(a, b) * left(b, a)).sum(1) >= least**0.5
            yield order[a[near]], order[b[near]]

    starts = np.flatnonzero(np.append(True, np.diff(x["list"]) != 0))
    sizes = np.diff(np.append(starts, len(order)))
    own = np.repeat(np.arange(len(starts)), sizes)
    wide = int(x["d"].max()) + 2
    fewest = np.maximum(np.floor(x["d"] - (1 - least) * x["n2"]), 0).astype(np.int64)
    end = np.searchsorted(own * wide + (wide - 1 - x["d"]), own * wide + (wide - 1 - fewest), side="right")
    d, t = 1, np.flatnonzero(np.repeat(sizes < DENSE, sizes))
    t = t[end[t] > t + d]
    while len(t):
        yield from told(t, t + d)
        d += 1
        t = t[end[t] > t + d]
    # floats of four bytes, which leave a pair more and never one less
    low, n2, d, share = np.float32(least - 1e-5), *(x[c].astype(np.float32) for c in ("n2", "d", "share"))
    size = (np.bitwise_count(x["b0"]).astype(np.int16) + np.bitwise_count(x["b1"])).astype(np.float32)
    unseen, limit, partner = n2 - size, low * n2, low / share
    kept, held_back = [], 0
    for first, n in zip(starts[sizes >= DENSE].tolist(), sizes[sizes >= DENSE].tolist()):
        for r in range(first, first + n, BLOCK):
            rows = slice(r, min(r + BLOCK, first + n))
            cols = slice(r + 1, int(end[rows].max()))
            if cols.stop <= cols.start:
                continue
            both = np.bitwise_count(x["b0"][rows, None] & x["b0"][None, cols]) + np.bitwise_count(x["b1"][rows, None] & x["b1"][None, cols])
            one = n2[rows, None] - np.maximum(size[rows, None] - both, d[rows, None] - d[None, cols])
            near = one * (unseen[None, cols] + both) >= limit[rows, None] * n2[None, cols]
            near &= share[None, cols] >= partner[rows, None]
            t, u = np.divmod(np.flatnonzero(near), cols.stop - cols.start)
            t, u = t + rows.start, u + cols.start
            kept.append((t[u > t], u[u > t]))
            held_back += len(t)
            if held_back > SOME:
                yield from told(*map(np.concatenate, zip(*kept)))
                kept, held_back = [], 0
    if kept:
        yield from told(*map(np.concatenate, zip(*kept)))


def similar_classes(told: DataFrame, percent: int = 90) -> DataFrame:
    """a, b (ids, a < b), dot, n2_a, n2_b of all pairs of classes with a cosine of ``percent`` or more."""
    least = percent * percent / 10_000 - 1e-6

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list; the last list of a batch waits for the next one."""
        kept = None
        for batch in itertools.chain(batches, [None]):
            now = pa.Table.from_batches([b for b in (kept, batch) if b is not None]) if kept is not None or batch is not None else None
            if now is None or not len(now):
                continue
            x = {c: now.column(c).to_numpy() for c in now.column_names}
            cut = len(now) if batch is None else int(np.searchsorted(x["list"], x["list"][-1]))
            kept = now.slice(cut).combine_chunks().to_batches()[0] if cut < len(now) else None
            if cut:
                x = {c: v[:cut] for c, v in x.items()} | {"b0": x["b0"][:cut].view(np.uint64), "b1": x["b1"][:cut].view(np.uint64)}
                for a, b in met_parts(x, least):
                    swap = x["id"][a] > x["id"][b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    if len(a):
                        yield pa.RecordBatch.from_pydict({"a": x["id"][a], "b": x["id"][b], "n2_a": x["n2"][a], "n2_b": x["n2"][b]})

    index = tiled(vectors(told), percent).repartition("list").sortWithinPartitions("list")
    found = save(index.mapInArrow(pairs, "a long, b long, n2_a long, n2_b long").distinct(), "candidates")
    asked = save(found.select(F.col("a").alias("id")).union(found.select("b")).distinct(), "asked_ids")
    few = asked.count() <= SENT
    # where they are too many to be sent, the texts of others aren't shuffled to find that out
    own = told.select("id", "words") if few else told.select("id", "words").filter(among("id", spotted(asked)))
    words = save(own.join(F.broadcast(asked) if few else asked, "id", "left_semi"), "asked")
    one, two = (words.select(F.col("id").alias(c), F.col("words").alias(f"words_{c}")) for c in "ab")
    met = found.join(one, "a").join(two, "b").withColumn("dot", F.pandas_udf("long")(exact_dots)("words_a", "words_b"))
    return met.filter(10_000 * F.col("dot") * F.col("dot") >= percent * percent * F.col("n2_a") * F.col("n2_b")).select("a", "b", "dot", "n2_a", "n2_b")


def exact_dots(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Inner products of the word counts of two texts of joined words; those of the texts met last are kept."""
    kept: dict[str, Counter] = {}
    for one, two in batches:
        out = np.zeros(len(one), np.int64)
        for i, pair in enumerate(zip(one, two)):
            if len(kept) > KEPT:
                kept.clear()
            x, y = (kept.get(t) or kept.setdefault(t, Counter(t.split(" "))) for t in pair)
            out[i] = sum(x[w] * y[w] for w in x.keys() & y.keys())
        yield pd.Series(out)


def paraphrase_pairs(sentences: DataFrame, key: str, percent: int = 90) -> DataFrame:
    """first_1, first_2 (key:pos of the first sentence of either class), copies_1, copies_2, similarity of each pair of similar classes."""
    told = save(classes(sentences, key), "classes")
    pairs = save(similar_classes(told, percent), "pairs")
    named = told.select("id", "first", "n").filter(among("id", spotted(pairs.select("a").union(pairs.select("b")))))
    one, two = (named.select(F.col("id").alias(c), F.col("first").alias(f"f_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    met = pairs.join(one, "a").join(two, "b")
    swap = F.col("f_a") < F.col("f_b")
    pick = lambda x, y: F.when(swap, x).otherwise(y)
    name = lambda f: F.concat_ws(":", f["key"].cast("string"), f["pos"].cast("string"))
    return met.select(pick(name(F.col("f_a")), name(F.col("f_b"))).alias("first_1"), pick(name(F.col("f_b")), name(F.col("f_a"))).alias("first_2"),
                      pick(F.col("n_a"), F.col("n_b")).alias("copies_1"), pick(F.col("n_b"), F.col("n_a")).alias("copies_2"),
                      (F.col("dot") / F.sqrt(F.col("n2_a").cast("double") * F.col("n2_b"))).alias("similarity"))


def paraphrase_links(sentences: DataFrame, key: str, percent: int = 90) -> DataFrame:
    """key, pos, class_id (key:pos of the class's first sentence), links (other sentences with a cosine of ``percent`` or more) of each
    sentence that has a link; no pairs of copies are listed."""
    told = save(classes(sentences, key), "classes")
    pairs = save(similar_classes(told, percent).select("a", "b"), "pairs")
    total = told.agg(F.sum("n")).first()[0] or 0
    # only classes of several sentences and those that are in a pair go on
    name = F.concat_ws(":", F.col("first.key").cast("string"), F.col("first.pos").cast("string"))
    met = told.withColumn("met", among("id", spotted(pairs.select("a").union(pairs.select("b"))))).filter("met or n > 1")
    met = save(met.select("id", "n", F.unhex(F.md5("words")).alias("cid"), name.alias("class_id")), "met_classes")
    near = pairs.union(pairs.select("b", "a")).join(met.select(F.col("id").alias("b"), F.col("n").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.sum("near").alias("near"))
    linked = save(met.join(near, "id", "left").select("cid", "n", "class_id", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links")).filter("links > 0"), "linked")
    # the members of a class that holds many of them are spread over SPREAD joins, so the sentences are cut once for all
    large = linked.filter(F.col("n") * SPREAD >= F.lit(total))
    own = members(sentences, key).filter(among("cid", spotted(linked.select("cid")))).join(F.broadcast(large.select("cid", F.lit(True).alias("large"))), "cid", "left")
    own = own.withColumn("part", F.when(F.col("large"), F.pmod(F.xxhash64(key, "pos"), F.lit(SPREAD)).cast("int")).otherwise(0))
    parts = F.when(F.col("n") * SPREAD >= F.lit(total), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    told = linked.select("cid", "class_id", "links", F.explode(parts).alias("part"))
    return own.join(told, ["cid", "part"]).select(key, "pos", "class_id", "links")
