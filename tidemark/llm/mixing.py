"""Operator 13: mixing sources to target weights by a low-discrepancy schedule.

Targets: sources, in the order of their names' code points with null last, weigh ``weights`` by turns and share ``share`` times the words of
all documents; no target exceeds ``most`` times the source's own words, and what is cut off is shared again by weight among the others until
none is above.

Schedule: the points of the golden ratio (i * PHI modulo 2**31) go through the targets' cumulative shares, so each slot of the mix gets a
source, and every stretch of slots has nearly the shares of the whole. The slots of a source are ranked; slots beyond its target
stay empty, and the few that the points leave short come at the end.

Blocks: a source's documents, shuffled by a hash that differs by epoch, are laid end to end and cut into blocks of ``block`` words. The
slot of rank k takes block k; the last one is cut where the target is reached. So each source gives its target to the nearest word, and
no document is taken more than ``most`` times.

Running sums go in two steps, over stretches and within them, so that no source, however large, is sorted as one. DataFrame operations throughout.

Edge cases: a null text has no words; documents without words are returned with nothing taken; rows without doc_id are shuffled by their
text; repeated rows are documents of their own (equal ones are interchangeable, so that results agree); a table without words has targets of 0; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import attach, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Modulus of the points and the odd number nearest to its golden section.
POINTS, PHI = 1 << 31, 1327217885
#: Words of a block, rows of a stretch, slots of one.
BLOCK, STRETCH, SLOTS = 1024, 4096, 1024
#: Up to so many sources their shares of the unit interval travel by broadcast.
FEW_SOURCES = 10_000


def before(df: DataFrame, keys: list[str], stretch: Column, order: list[str | Column], value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one, by ``keys``. ``stretch`` numbers runs of the order, of a bounded number of rows each."""
    df = df.withColumn("__s", stretch)
    sums = df.groupBy(*keys, "__s").agg(F.sum(value).alias("__sum"))
    upto = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = df.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [*keys, "__s"])
    return met.withColumn(out, F.col("__before") + F.col("__within")).drop("__s", "__before", "__within")


def numbered(sources: DataFrame) -> DataFrame:
    """``sid``: consecutive numbers of the sources in code point order, null last; ranges of names are counted, then numbered within."""
    ranged = saved(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("__p", F.spark_partition_id()), "sources").withColumn("__one", F.lit(1))
    return before(ranged, [], F.col("__p"), [F.asc_nulls_last("source")], "__one", "sid").drop("__p", "__one")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``target`` (words, not rounded) of sources (sid, source_size); a round of sharing sees three sums."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    whole = share * sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = -1.0  # words for a weight of one; sources that this fills take no part in the next sharing
    while True:
        full = F.col("cap") <= level * F.col("weight")
        held = sources.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight")).first()
        now = (whole - held["cap"]) / held["weight"] if held["weight"] else level
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("weight", "cap")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """sid, rank, slot: which block of which source (sid, wanted) each slot of the mix takes."""
    spark = sources.sparkSession
    total, many = sources.agg(F.coalesce(F.sum("wanted"), F.lit(0)), F.count("*")).first()
    slots = -(-total // block)
    point = lambda c: F.floor(c / max(total, 1) * POINTS).cast("long")
    shares = before(sources.select("sid", "wanted"), [], F.floor(F.col("sid") / STRETCH), ["sid"], "wanted", "lower")
    blocks = F.ceil(F.col("wanted") / block).cast("long")
    shares = shares.select("sid", blocks.alias("blocks"), point(F.col("lower")).alias("lo"), point(F.col("lower") + F.col("wanted")).alias("hi"))
    # points and shares meet in cells of the unit interval
    bits = min(20, max(10, (4 * many).bit_length()))
    cell = lambda c: F.shiftright(c, 31 - bits)
    covered = shares.filter("hi > lo").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    covered = F.broadcast(covered) if many <= FEW_SOURCES else covered
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % POINTS) * PHI % POINTS).alias("x")).withColumn("cell", cell(F.col("x")))
    met = points.join(covered, "cell").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "sid", "blocks", F.lit(1).alias("one"))
    ranked = before(met, ["sid"], F.floor(F.col("slot") / SLOTS), ["slot"], "one", "rank")
    # what the points leave short, a few blocks of each source
    given = ranked.groupBy("sid").agg(F.count("*").alias("given"))
    short = shares.join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).filter(F.col("given") < F.col("blocks"))
    short = short.withColumn("n", F.col("blocks") - F.col("given"))
    short = before(short, [], F.floor(F.col("sid") / STRETCH), ["sid"], "n", "earlier").withColumn("rank", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)))
    late = short.select("sid", "rank", (slots + F.col("earlier") + F.col("rank") - F.col("given")).alias("slot"))
    return ranked.filter(F.col("rank") < F.col("blocks")).select("sid", "rank", "slot").unionByName(late)


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it is made of.

    The mix: slot, place (words of the slot before this piece), at (the document's row), doc_id, first (word of the document, from 0), words.
    The documents: at, doc_id, size, source_size, target, one row each.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    rows = saved(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("at")), "rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = targets(saved(numbered(found), "numbered"), weights, share, most)
    sources = saved(sources.withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long")).withColumn("held", F.col("docs")), "targets")
    told = saved(attach(rows, sources, ["source"], "docs", rows.count()).drop("source"), "told")

    copies = saved(told.groupBy("sid", "key", "size").agg(F.count("*").alias("n")).filter(F.col("n") > STRETCH).withColumn("copies", F.col("n")), "copies")
    own = told.withColumn("copies", F.lit(None).cast("long")) if copies.isEmpty() else attach(told, copies, ["sid", "key", "size"], "n", told.count())
    # an order of each epoch in stretches; very many rows that are alike make stretches of their own
    epochs = own.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).filter(F.col("epoch") * F.col("source_size") < F.col("wanted"))
    epochs = epochs.withColumn("h", F.xxhash64("key", "epoch", F.lit(seed)))
    run = F.floor((F.col("h") / 2.0**64 + 0.5) * F.ceil(F.col("held") / STRETCH))
    alike = F.when(F.col("copies").isNotNull(), F.struct(F.col("h"), F.col("size"), F.pmod(F.xxhash64("at"), F.ceil(F.col("copies") / STRETCH)).alias("part")))
    placed = before(epochs, ["sid", "epoch"], F.struct(run.alias("run"), alike.alias("alike")), ["h", "doc_id", "size", "at"], "size", "earlier")
    start = F.col("epoch") * F.col("source_size") + F.col("earlier")
    placed = placed.withColumn("start", start).withColumn("end", F.least(start + F.col("size"), "wanted")).filter("start < end")
    cut = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest("start", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = cut.select("sid", "rank", "at", "doc_id", (low - F.col("rank") * block).alias("place"), (low - F.col("start")).alias("first"), (high - low).alias("words"))
    mix = pieces.join(schedule(sources, block), ["sid", "rank"]).select("slot", "place", "at", "doc_id", "first", "words")
    return mix, told.select("at", "doc_id", "size", "source_size", "target")


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the row) of every document."""
    mix, rows = mixture(docs, **how)
    sums = mix.groupBy("at").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "at", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
