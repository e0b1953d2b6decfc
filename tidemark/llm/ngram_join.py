"""Operator 8: n-gram Jaccard join with size-banded tiles, hashed bitmap signatures and exact sorted-array intersection.

1. Every document becomes the sorted array of the hashes of its distinct shingles. Documents with equal sets are one class.
2. Each class names the shingles of its prefix: two sets of the wanted similarity share at least one of the first
   n - ceil(0.8 n) + 1 shingles in any fixed order. The order takes shingles that many documents share last, so that
   common passages hardly bring sets together.
3. The classes that share a prefix shingle are a tile, ordered by size. First each class meets the one before it and a hub of
   its stretch; pairs whose bitmap signatures allow the similarity are candidates, and the components of candidates get a
   label. Only tiles that still hold several labels are looked at pair by pair, across labels alone. The components of all
   candidates are regions; similar sets are always in one region.
4. In a region the bits that one signature has and the other has not bound the overlap from above; pairs that pass are
   intersected exactly. A region beyond ``TILE`` classes or ``TILE_SHINGLES`` first links its classes to a few hubs of their
   size band. Then it is cut into tiles by size band (a factor 1.25, so that only equal and neighbouring bands can meet),
   label and hash; each pair of tiles is a task of its own, and pairs of tiles of one label alone are left out: what is
   connected needn't be compared.

So a group of near copies costs work in proportion to its size, wherever most of its copies are similar to one of its hubs; pairs are never
all written, and no task holds more than two tiles. The rest of a group that no hub reaches is compared with all of it, in tiles.

Edge cases: texts that are null or have no word have an empty set, no links and their own doc_id as component; a text of fewer than five
words is one shingle; sets are compared by 64-bit hashes of their shingles and known by a 64-bit fingerprint and their size; repeated rows and
rows without doc_id belong to the class of their text (component_id is null only if no member has an id); a text of any length is one
class and alone may exceed ``TILE_SHINGLES``; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import slices
from tidemark.llm.common import as_text, attach, bounded_batches, components, leaving_memory, saved

WORDS = 5
TILE, TILE_SHINGLES = 2048, 2_000_000
#: Classes of a tile that share a hub, and hubs of a size band of a large region.
STRETCH, HUBS = 64, 8
#: Classes from which on a tile is compared by arrays.
WIDE = 12
#: A shingle counts as common from this many documents on, and from so many that at most MOST_COMMON shingles can be.
COMMON, MOST_COMMON = 64, 2_000_000
#: Shingles that a worker looks over at once for those that repeat, and times it must repeat there to be reported.
WINDOW, REPEATS = 4_000_000, 3
#: Characters whose shingles are made at once, of one text at least.
SLICE = 500_000

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, np.uint64)
_PLACE = _random.integers(1, 2**63, WORDS, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse (modulo 2**64) to the powers 0 to n - 1."""
    if not _powers or len(_powers[0]) < n:
        size, inverse = max(n, 1 << 20), pow(_BASE, -1, 2**64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    none = np.empty(0, np.int64)
    raw = [(t or "").encode().lower() for t in texts]  # bytes: only A-Z change
    flat = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    if len(flat) < 3:
        return [none] * len(texts)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    power, inverse = powers(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * power[:-1])])
    word = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _PLACE[0])
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, begins)
    whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        whole += word[k:k + len(whole)] * _PLACE[k]
    whole = mixed(whole).view(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([(word[a:b] * _PLACE[:b - a]).sum() + np.uint64(b - a)], np.uint64)).view(np.int64))
        else:
            out.append(none)
    return out


def class_id(own: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    u = own.view(np.uint64)
    return int(mixed(np.array([mixed(u + np.uint64(len(u))).sum()], np.uint64)).view(np.int64)[0])


def signature(own: np.ndarray) -> bytes:
    """Bitmap of a set, about one bit a shingle; wider ones fold into narrower ones by halves."""
    bits = max(512, 1 << int(len(own) - 1).bit_length())
    row = np.zeros(bits, np.uint8)
    row[own & (bits - 1)] = 1
    return np.packbits(row, bitorder="little").tobytes()


def folded(x: int, wide: int, narrow: int) -> int:
    while wide > narrow:
        wide //= 2
        x = (x >> wide) | (x & ((1 << wide) - 1))
    return x


def may_be_similar(a: tuple[int, int, int], b: tuple[int, int, int], percent: int) -> bool:
    """Whether the bit counts allow the similarity; each side is size, bits as a number, width of the bitmap."""
    (n, x, w), (m, y, v) = a, b
    x, y = folded(x, w, v), folded(y, v, w)
    both = x & y
    most = min(n - (x ^ both).bit_count(), m - (y ^ both).bit_count())
    return 100 * most >= percent * (n + m - most)


def similar(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; about four bits a shingle for the largest."""
    bits = int(min(1 << 16, max(256, 1 << int(np.ceil(np.log2(4 * max(len(s) for s in sets)))))))
    out = np.empty((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        row = np.zeros(bits, np.uint8)
        row[s & (bits - 1)] = 1
        out[i] = np.packbits(row).view(np.uint64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def tile_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = 80, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a tile or, with ``side``, all similar sets of different sides; sets of equal
    ``labels`` are known to be connected."""
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    ids, size, sets = ids[order], size[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    label = np.arange(len(ids)) if labels is None else np.unique(labels[order], return_inverse=True)[1]
    bits, links = signatures(sets), []
    for i in range(len(ids) - 1, 0, -1):
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        near = np.arange(low, i)
        near = near[label[near] != label[i]] if side is None else near[(label[near] != label[i]) & (side[near] != side[i])]
        if not len(near):
            continue
        most = np.minimum(size[i] - np.bitwise_count(bits[i] & ~bits[near]).sum(1, dtype=np.int64), size[near] - np.bitwise_count(bits[near] & ~bits[i]).sum(1, dtype=np.int64))
        fine = similar(most, size[i], size[near], percent)
        for j in near[fine][np.argsort(-most[fine], kind="stable")].tolist():
            if label[j] != label[i] and similar(overlap(sets[i], sets[j]), size[i], size[j], percent):
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


class Groups:
    """Union-find over labels."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x


def candidate_links(tile: list[tuple[int, int, int, tuple[int, int, int]]], groups: Groups, percent: int) -> list[tuple[int, int]]:
    """Links between classes of a tile (cid, label, side, size and bitmap; ordered by size) that the bitmaps allow, as many
    as connect their labels. Where sides differ at all, only classes of different sides meet."""
    out: list[tuple[int, int]] = []
    sided = any(t[2] for t in tile)
    if len(tile) < WIDE:
        for i in range(len(tile) - 1, 0, -1):
            c, own_label, own_side, own = tile[i]
            for j in range(i - 1, -1, -1):
                d, label, side, other = tile[j]
                if 100 * other[0] < percent * own[0]:
                    break
                if sided and side == own_side:
                    continue
                a, b = groups.root(own_label), groups.root(label)
                if a != b and may_be_similar(own, other, percent):
                    groups.parent[a] = b
                    out.append((c, d))
        return out
    ids, side, size = np.array([t[0] for t in tile], np.int64), np.array([t[2] for t in tile]), np.array([t[3][0] for t in tile], np.int64)
    width = np.array([t[3][2] for t in tile], np.int64)
    named = [groups.root(t[1]) for t in tile]
    names, label = np.unique(named, return_inverse=True)
    places = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    bits = {w: np.stack([np.frombuffer(tile[k][3][1].to_bytes(w // 8, "little"), np.uint64) for k in p]) for w, p in places.items()}
    for i in range(len(tile) - 1, 0, -1):
        if (label == label[i]).all():
            break
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        for w, place in places.items():  # bitmaps of one width at a time; the wider side folds
            if w > width[i]:
                continue
            a, b = np.searchsorted(place, (low, i))
            near = place[a:b]
            wanted = label[near] != label[i]
            if sided:
                wanted &= side[near] != side[i]
            if not wanted.any():
                continue
            near, theirs = near[wanted], bits[w][a:b][wanted]
            own = np.frombuffer(folded(tile[i][3][1], int(width[i]), w).to_bytes(w // 8, "little"), np.uint64)
            most = np.minimum(size[i] - np.bitwise_count(own & ~theirs).sum(1, dtype=np.int64), size[near] - np.bitwise_count(theirs & ~own).sum(1, dtype=np.int64))
            for j in near[similar(most, size[i], size[near], percent)].tolist():
                if label[j] != label[i]:
                    out.append((int(ids[i]), int(ids[j])))
                    groups.parent[groups.root(int(names[label[j]]))] = groups.root(int(names[label[i]]))
                    label[label == label[j]] = label[i]
    return out


def band_of(n: str, percent: int):
    """Size band: only classes of equal and neighbouring bands can be similar."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("long")


def capacity(band: str, percent: int):
    """Classes of a tile of this band, so that it holds about TILE_SHINGLES at most."""
    return F.greatest(F.least(F.lit(float(TILE)), F.floor(F.lit(float(TILE_SHINGLES)) / F.pow(F.lit(100 / percent), F.col(band) + 1))), F.lit(1.0))


def in_tile_pairs(rows: DataFrame, name: str, percent: int = 80) -> DataFrame:
    """``rows`` (root, band, cid, n, label) with ``at``, the pairs of tiles that each belongs to.

    In each root the commonest label has tiles of its own, which only meet the tiles of all other labels.
    """
    rows = rows.select("root", "band", "cid", "n", "label")
    top = rows.groupBy("root", "label").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("label", F.struct("m", "label")).alias("top"))
    rows = saved(rows.join(top, "root").withColumn("mixed", (F.col("label") != F.col("top")).cast("int")).drop("top"), f"{name}_rows")
    kinds = saved(rows.groupBy("root", "band", "mixed").agg(F.count("*").alias("m")).withColumn("k", F.ceil(F.col("m") / capacity("band", percent))), f"{name}_kinds")
    tiles = kinds.select("root", "band", "mixed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"))
    other = tiles.select(*(F.col(c).alias(f"{c}2") for c in ("root", "band", "mixed", "salt")))
    near = tiles.withColumn("next", F.explode(F.array("band", F.col("band") + 1)))
    ordered = (F.col("band2") > F.col("band")) | (F.col("mixed2") > F.col("mixed")) | ((F.col("mixed2") == F.col("mixed")) & (F.col("salt2") >= F.col("salt")))
    meets = near.join(other, (F.col("root") == F.col("root2")) & (F.col("next") == F.col("band2"))).filter(ordered & (F.col("mixed") + F.col("mixed2") > 0))
    pair = F.concat_ws("/", "band", "mixed", "salt", "band2", "mixed2", "salt2")
    itself = (F.col("band2") == F.col("band")) & (F.col("mixed2") == F.col("mixed")) & (F.col("salt2") == F.col("salt"))
    spot = lambda side: F.struct(pair.alias("pair"), F.lit(side).alias("side"))
    lists = meets.select("root", "band", "mixed", "salt", spot(0).alias("at")).union(meets.filter(~itself).select("root", "band2", "mixed2", "salt2", spot(1).alias("at"))).groupBy("root", "band", "mixed", "salt").agg(F.collect_list("at").alias("at"))
    return rows.join(kinds.select("root", "band", "mixed", "k"), ["root", "band", "mixed"]).withColumn("salt", F.pmod("cid", "k")).join(lists, ["root", "band", "mixed", "salt"]).drop("mixed", "salt", "k")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text), further its text's hash h and component,
    which rows without doc_id have too (null: no words)."""
    spark = docs.sparkSession
    docs = bounded_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kind 0: a document's set size and class. Kind 1: a shingle that repeats among the worker's documents."""
        held, size = [], 0

        def repeats() -> pd.DataFrame:
            h = np.concatenate([np.empty(0, np.int64), *held])
            held.clear()
            h.sort()
            often = np.unique(h[:1 - REPEATS][h[:1 - REPEATS] == h[REPEATS - 1:]])
            n = np.searchsorted(h, often, "right") - np.searchsorted(h, often, "left")
            return pd.DataFrame({"kind": 1, "id": often, "doc": None, "n": n, "cid": 0, "bits": None})

        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts, SLICE):
                sets = shingle_sets(texts[part], words)
                yield pd.DataFrame({"kind": 0, "id": batch["h"].iloc[part].array, "doc": batch["doc_id"].iloc[part].array, "n": [len(s) for s in sets], "cid": [class_id(s) if len(s) else 0 for s in sets], "bits": [signature(s) for s in sets]})
                held += sets
                size += sum(map(len, sets))
                if size >= WINDOW:
                    yield repeats()
                    size = 0
        yield repeats()

    scanned = saved(docs.select(as_text("doc_id"), "text", "h").mapInPandas(leaving_memory(scan), "kind int, id long, doc string, n long, cid long, bits binary"), "sets")
    rows = scanned.filter("kind = 0").select(F.col("doc").cast("long").alias("doc_id"), F.col("id").alias("h"), "n", "cid")
    classes = saved(rows.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("rep"), F.min_by("h", F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("rep_h"), F.count("*").alias("copies")), "classes")
    bitmaps = scanned.filter("kind = 0 and n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    totals = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.count_if(F.col("n") > 0).alias("docs")).first()
    least = max(COMMON, totals["shingles"] // MOST_COMMON)  # so at most MOST_COMMON shingles reach it
    common = scanned.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("id").toPandas()["id"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(np.sort(common))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, seen = shared.value, set()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts, SLICE):
                sets = [s for s in shingle_sets(texts[part], words) if len(s)]
                keep, names, sizes = [], [], []
                for s in sets:
                    c = class_id(s)
                    if c in seen:
                        continue
                    seen.add(c)
                    first = len(s) - -(-percent * len(s) // 100) + 1
                    if len(late):
                        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                        is_late = late[at] == s
                        s_first = s[~is_late][:first]
                        head = s_first if len(s_first) == first else np.concatenate([s_first, s[is_late][:first - len(s_first)]])
                    else:
                        head = s[:first]
                    keep.append(head)
                    names.append(np.full(len(head), c))
                    sizes.append(np.full(len(head), len(s), np.int32))
                if keep:
                    yield pd.DataFrame({"h": np.concatenate(keep), "cid": np.concatenate(names), "n": np.concatenate(sizes)})

    by_size = Window.partitionBy("h").orderBy("n", "cid")
    fits = lambda small, large: F.coalesce(100 * small >= percent * large, F.lit(False))
    once = docs.mapInPandas(leaving_memory(prefixes), "h long, cid long, n int").withColumn("same", F.lag("cid").over(by_size).eqNullSafe(F.col("cid"))).filter("not same").drop("same")
    met = once.withColumn("met", fits(F.lag("n").over(by_size), F.col("n")) | fits(F.col("n"), F.lead("n").over(by_size))).filter("met").drop("met")
    stretch = Window.partitionBy("h", "stretch").orderBy("n", "cid")
    met = met.withColumn("stretch", F.floor(F.row_number().over(by_size) / STRETCH)).withColumn("before", F.when(fits(F.lag("n").over(by_size), F.col("n")), F.lag("cid").over(by_size)))
    shared_prefix = saved(met.withColumn("hub", F.when(fits(F.first("n").over(stretch), F.col("n")), F.first("cid").over(stretch))).drop("stretch"), "shared_prefix")

    # candidates: each class with the one before it in a tile and with its hub there
    bitmaps = saved(bitmaps, "bitmaps")
    star = shared_prefix.select(F.col("cid").alias("a"), F.explode(F.array("before", "hub")).alias("b")).filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = star.join(bitmaps.select(F.col("cid").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x")), "a").join(bitmaps.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fine = [may_be_similar((n, int.from_bytes(x, "little"), 8 * len(x)), (m, int.from_bytes(y, "little"), 8 * len(y)), percent) for n, x, m, y in zip(batch["n"].tolist(), batch["x"], batch["m"].tolist(), batch["y"])]
            yield batch.loc[np.array(fine, bool), ["a", "b"]]

    first_links = saved(star.select("a", "b", "n", "x", "m", "y").mapInPandas(leaving_memory(bounded), "a long, b long"), "first_links")
    first = components(first_links, "first").select(F.col("node").alias("cid"), F.col("root").alias("label"))

    # tiles whose classes have several labels; in a tile of three every pair has been looked at
    labelled = shared_prefix.select("h", "cid", "n").join(first, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    shape = labelled.groupBy("h").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("m > 3 and low != high").select("h", "m")
    open_tiles = saved(labelled.join(shape, "h").select("h", "m", "cid", "n", "label"), "open_tiles")
    sides = "array<struct<pair:string,side:int>>"
    whole = F.array(F.struct(F.lit("").alias("pair"), F.lit(0).alias("side"))).cast(sides)
    large_tiles = open_tiles.filter(F.col("m") > TILE).select(F.col("h").alias("root"), "cid", "n", "label", band_of("n", percent).alias("band"))
    dealt_tiles = open_tiles.filter(F.col("m") <= TILE).select(F.col("h").alias("root"), "cid", "n", "label", whole.alias("at"))
    if not large_tiles.isEmpty():
        dealt_tiles = dealt_tiles.unionByName(in_tile_pairs(large_tiles, "open", percent).select("root", "cid", "n", "label", "at"))
    dealt_tiles = dealt_tiles.withColumn("at", F.explode("at")).select("root", F.col("at.pair").alias("pair"), F.col("at.side").alias("side"), "cid", "n", "label")
    dealt_tiles = dealt_tiles.join(bitmaps.select("cid", "bits"), "cid").repartition("root", "pair").sortWithinPartitions("root", "pair", "n", "cid")

    def bounded_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links that span the labels of the task's tiles; what is connected before isn't looked at again."""
        groups, tile, at = Groups(), [], None
        for batch in batches:
            out: list = []
            for root, pair, side, cid, label, n, bits in zip(batch["root"].tolist(), batch["pair"], batch["side"].tolist(), batch["cid"].tolist(), batch["label"].tolist(), batch["n"].tolist(), batch["bits"]):
                if (root, pair) != at:
                    out += candidate_links(tile, groups, percent)
                    tile, at = [], (root, pair)
                tile.append((cid, label, side, (n, int.from_bytes(bits, "little"), 8 * len(bits))))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(candidate_links(tile, groups, percent), columns=["a", "b"], dtype=np.int64)

    more = dealt_tiles.select("root", "pair", "side", "cid", "label", "n", "bits").mapInPandas(leaving_memory(bounded_links), "a long, b long")
    regions = components(first_links.union(more), "regions")

    # members of regions with their sets; of large regions, links to hubs first
    members = saved(regions.join(classes, regions["node"] == classes["cid"]).select("cid", "rep", "rep_h", "n", "root", band_of("n", percent).alias("band")), "members")
    size = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    large = saved(size.filter((F.col("m") > TILE) | ((F.col("s") > TILE_SHINGLES) & (F.col("m") > 1))).select("root", F.lit(True).alias("large")), "large")
    placed = members.join(large, "root", "left")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # repeated rows
        for batch in batches:
            batch = batch[~batch["cid"].isin(seen)].drop_duplicates("cid")
            seen.update(batch["cid"])
            texts = batch["text"].tolist()
            for part in slices(texts, SLICE):
                own = batch[["cid", "root", "n", "band", "large"]].iloc[part].reset_index(drop=True)
                own["shingles"] = shingle_sets(texts[part], words)
                yield own

    found = docs.join(placed, docs["doc_id"].eqNullSafe(placed["rep"]) & (docs["h"] == placed["rep_h"])).select("cid", "root", "n", "band", "large", "text").mapInPandas(leaving_memory(arrays), "cid long, root long, n long, band long, large boolean, shingles array<long>")

    def link(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates(["side", "cid"])
        side = df["side"].to_numpy()
        got = tile_links(df["cid"].to_numpy(np.int64), [np.asarray(s, np.int64) for s in df["shingles"]], side if side.any() else None, percent, df["label"].to_numpy(np.int64)) if len(df) > 1 else []
        return pd.DataFrame(got, columns=["a", "b"], dtype=np.int64)

    def linked(df: DataFrame) -> DataFrame:
        dealt = df.withColumn("at", F.explode("at")).select("root", F.col("at.pair").alias("pair"), F.col("at.side").alias("side"), "cid", "label", "shingles")
        return dealt.groupBy("root", "pair").applyInPandas(link, "a long, b long")

    some_large = not large.isEmpty()
    if some_large:
        found = saved(found, "member_sets")
        ofs = found.filter("large").drop("large")
        cap = capacity("band", percent)
        counts = ofs.groupBy("root", "band").agg(F.count("*").alias("m"), F.min_by("cid", F.xxhash64("cid")).alias("any")).withColumn("k", F.ceil(F.col("m") / cap))
        counts = saved(counts.select("root", "band", "k"), "large_bands")
        chosen = Window.partitionBy("root", "band").orderBy(F.xxhash64("cid", F.lit(7)), "cid")
        hubs = ofs.select("root", "band", "cid").distinct().withColumn("r", F.row_number().over(chosen)).filter(F.col("r") <= HUBS).drop("r")
        hubs = saved(ofs.join(hubs, ["root", "band", "cid"], "left_semi").dropDuplicates(["root", "cid"]), "hubs")
        spots = counts.select("root", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"))
        sent = hubs.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(spots, ["root", "band"])
        own = ofs.join(counts, ["root", "band"]).withColumn("salt", F.pmod("cid", "k"))
        spot = F.concat_ws("/", "band", "salt")
        at = lambda side: F.array(F.struct(spot.alias("pair"), F.lit(side).alias("side"))).cast(sides)
        star_links = saved(linked(own.select("root", at(0).alias("at"), "cid", F.col("cid").alias("label"), "shingles").unionByName(sent.select("root", at(1).alias("at"), "cid", F.col("cid").alias("label"), "shingles"))), "hub_links")
        told_first = components(star_links, "hub_groups").select(F.col("node").alias("cid"), F.col("root").alias("label"))
        with_label = ofs.drop("shingles").distinct().join(told_first, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        where = in_tile_pairs(with_label, "region", percent).select("root", "cid", "label", "at")
        links = linked(ofs.join(where, ["root", "cid"]).select("root", "at", "cid", "label", "shingles")).union(star_links)
        links = links.union(linked(found.filter("large is null").select("root", whole.alias("at"), "cid", F.col("cid").alias("label"), "shingles")))
    else:
        links = linked(found.select("root", whole.alias("at"), "cid", F.col("cid").alias("label"), "shingles"))

    labels = components(links, "links")
    named = saved(classes.join(labels, classes["cid"] == labels["node"], "left").select("cid", "n", "rep", "copies", F.coalesce("root", "cid").alias("component")), "named")
    smallest = saved(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")), "smallest")
    told = saved(attach(named, smallest, ["component"], "m", named.count()).select("cid", "n", "copies", "component", "component_id"), "told")
    full = attach(rows.filter("n > 0"), told, ["cid", "n"], "copies", totals["docs"])
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "h", F.lit(None).cast("long").alias("component"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "h", "component").unionByName(alone)
