"""Operator 5: language identification by interpolated Kneser-Ney character models.

For each language seen among the labelled rows an order-4 model is kept in sorted hash arrays: for each order the sorted
hashes of its n-grams with their discounted probabilities, and the sorted hashes of its contexts with their back-off
weights. N-grams are hashed from whole code points, so every letter of every script counts as itself. A text gets the
language of lowest cross-entropy per predicted character. Rejection is calibrated on labelled texts that the counts have
not seen: a text is rejected if its cross-entropy lies beyond all of those of its language by over six standard errors
for its length.

The models are fitted on at most ``per_language`` documents a language (those of smallest hash of doc_id), each a whole
text; every whole text is scored.

Edge cases: a text that is null or holds no letter gets ``und``, score 0 and is rejected; with no labelled row at all
every text gets ``und``; rows with a null doc_id are never learned from and count as not held out; of rows that repeat a doc_id and
language the one whose text has the smallest hash is learned from; repeated rows and further columns change no prediction; texts of any
length are scored in one piece, as sums over their characters; ties go to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import slices
from tidemark.llm.common import as_text, bounded_batches, leaving_memory, saved

ORDER = 4
#: Characters that are scored at once, one text at least.
SLICE = 500_000
#: N-grams whose probabilities a worker keeps; beyond, it starts anew. It changes no result.
MEMO = 2_000_000
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    """0 for the rows that are held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def hashed(*points: np.ndarray) -> np.ndarray:
    """A 64-bit mix of n-grams, given as the code points of each place (0 is a border)."""
    x = np.full(points[0].shape, 0x9E3779B97F4A7C15 * (len(points) + 1) % 2**64, np.uint64)
    for p in points:
        x = (x ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


class KneserNey:
    """One language: per order the sorted n-gram hashes with discounted probabilities, context hashes with weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, classes: int):
        """``grams`` has a row of ORDER code points for each distinct n-gram, the predicted one last."""
        self.classes = classes
        self.orders = []
        for _ in range(ORDER):
            discount = 0.5
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            if ones and twos:
                discount = ones / (ones + 2 * twos)
            before = hashed(*grams.T[:-1]) if grams.shape[1] > 1 else np.zeros(len(grams), np.uint64)
            context, inverse = np.unique(before, return_inverse=True)
            total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
            own = hashed(*grams.T)
            order = np.argsort(own)
            self.orders.append((own[order], ((counts - discount) / total[inverse])[order], context, discount * kinds / total))
            # the next lower order counts in how many contexts an n-gram goes on from
            if grams.shape[1] > 1:
                _, first, counts = np.unique(hashed(*grams.T[1:]), return_index=True, return_counts=True)
                grams = grams[first, 1:]

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each row's last character after the others."""
        p = np.full(len(grams), 1.0 / self.classes)
        for n in range(1, ORDER + 1):
            keys, share, contexts, weight = self.orders[ORDER - n]
            own = grams.T[ORDER - n:]
            before = hashed(*own[:-1]) if n > 1 else np.zeros(len(grams), np.uint64)
            p = looked_up(keys, share, hashed(*own), 0.0) + looked_up(contexts, weight, before, 1.0) * p
        return np.log(p)


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER code points of each predicted character of the texts (letters, and the border behind a letter) and those
    before it, one row a place, and for each the number of its text."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n\n\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[points], points, 0).astype(np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 3 for t in low])
    kept = c > 0
    kept[1:] |= c[:-1] > 0
    c, owner = c[kept], owner[kept]
    out = np.zeros((ORDER, len(c)), np.uint32)
    out[-1] = c
    for k in range(1, ORDER):
        out[ORDER - 1 - k, k:] = np.where(owner[k:] == owner[:-k], c[:-k], 0) if len(c) > k else 0
    return out, owner


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct n-grams of places, a place of each, and for all places the number of their n-gram."""
    key, first, inverse = np.unique(hashed(*rows), return_index=True, return_inverse=True)
    return key, first, inverse


@dataclass
class Model:
    names: list[str]
    languages: list[KneserNey]
    ceiling: np.ndarray = field(default_factory=lambda: np.empty(0))
    spread: np.ndarray = field(default_factory=lambda: np.empty(0))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy (natural units a character) of each text in each language, and the characters predicted."""
        if not hasattr(self, "_keys") or len(self._keys) > MEMO:
            self._keys, self._known = np.empty(0, np.uint64), np.empty((0, len(self.names)), np.float32)
        rows, owner = places(texts)
        key, first, inverse = distinct(rows)
        new = looked_up(self._keys, np.ones(len(self._keys)), key, 0.0) == 0
        if new.any():  # n-grams met for the first time by this worker
            grams = rows[:, first[new]].T
            told = np.stack([m.log_probability(grams) for m in self.languages], 1).astype(np.float32)
            at = np.searchsorted(self._keys, key[new])
            self._keys, self._known = np.insert(self._keys, at, key[new]), np.insert(self._known, at, told, axis=0)
        value = self._known[np.searchsorted(self._keys, key)]
        n = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, value[inverse, k], len(texts)) for k in range(len(self.names))], 1)
        return -sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        whole = [t or "" for t in texts]
        if not self.names:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(whole), "score": 0.0, "cross_entropy": None, "rejected": True})
        entropy, n = self.scores(whole)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(whole)), best]
        score = 1 / np.exp(-(entropy - least[:, None]) * np.minimum(n, 20)[:, None]).sum(1)
        beyond = least > self.ceiling[best] + 6 * self.spread[best] / np.sqrt(np.maximum(n, 1))
        none = n == 0
        return pd.DataFrame({"lang_pred": np.where(none, UNKNOWN, np.array(self.names, object)[best]), "score": np.where(none, 0.0, score), "cross_entropy": np.where(none, np.nan, least), "rejected": beyond | none})


def fit(docs: DataFrame, per_language: int = 400) -> Model:
    """Fit on the rows that are not held out and have a language: see the module for the bound."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    at = F.xxhash64("doc_id")
    known = saved(labelled.select("doc_id", "lang").distinct(), "labelled")
    # of the hash's range a share that holds about four times the wanted number, so that no task ranks a whole language
    share = known.groupBy("lang").agg((4.0 * per_language / F.count("*")).alias("share"))
    near = known.join(F.broadcast(share.filter("share < 1")), "lang", "left").filter(F.coalesce(F.pmod(at, F.lit(1 << 30)) < F.col("share") * (1 << 30), F.lit(True)))
    first = Window.partitionBy("lang").orderBy(F.pmod(at, F.lit(1 << 30)), at, "doc_id")
    chosen = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language).select("doc_id", "lang", (F.col("k") % 5 == 0).alias("judge"))
    chosen = saved(chosen, "chosen")
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "judge").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = saved(sample, "language_sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                texts = own["text"].tolist()
                for part in slices(texts, SLICE):
                    rows, _ = places(texts[part])
                    _, at, inverse = distinct(rows)
                    yield pd.DataFrame({"lang": lang, **{f"c{i}": rows[i, at].astype(np.int32) for i in range(ORDER)}, "n": np.bincount(inverse, minlength=len(at))})

    grams = [f"c{i}" for i in range(ORDER)]
    schema = "lang string, " + ", ".join(f"{c} int" for c in grams) + ", n long"
    counts = bounded_batches(sample.filter(~F.col("judge"))).select("lang", "text").mapInPandas(count, schema).groupBy("lang", *grams).agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    classes = counts[grams[-1]].nunique() + 2
    models = []
    for name in names:
        own = counts[counts["lang"] == name].sort_values(grams)
        models.append(KneserNey(own[grams].to_numpy(np.uint32), own["n"].to_numpy(np.float64), classes))
    model = Model(list(names), models)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch[batch["lang"].isin(names)]
            texts = every["text"].tolist()
            for part in slices(texts, SLICE):
                own = every.iloc[part]
                entropy, n = model.scores(texts[part])
                at = own["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
                yield pd.DataFrame({"lang": own["lang"].array, "entropy": entropy[np.arange(len(own)), at], "n": n})

    seen = bounded_batches(sample.filter("judge")).select("lang", "text").mapInPandas(judge, "lang string, entropy double, n long").filter("n > 0").groupBy("lang").agg(F.max("entropy").alias("top"), F.stddev_pop(F.col("entropy") * F.sqrt("n")).alias("spread")).toPandas().set_index("lang")
    model.ceiling = np.array([seen["top"].get(x, np.inf) for x in names])
    model.spread = np.array([seen["spread"].get(x, 0.0) for x in names])
    return model


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of each whole text; ``keep`` names columns to carry along."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts, SLICE):
                out = held.value.predict(texts[part])
                yield pd.concat([batch[columns].iloc[part].reset_index(drop=True), out], axis=1)

    read = bounded_batches(docs).withColumn("doc_id", as_text("doc_id"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*columns).schema)
    inputs = list(dict.fromkeys([*columns, "text"]))
    found = read.select(*inputs).mapInPandas(leaving_memory(run), f"{kept}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
