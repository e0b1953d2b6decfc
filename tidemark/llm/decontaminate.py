"""Operator 7: benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become template tokens: numbers, units behind a number and names (capitalised words) are typed placeholders, other
words are themselves in lower case without outer punctuation. A capitalised word that opens a sentence or a window may be a name or not,
and a text may be written without capitals, so that a window has up to three readings: openers as words, openers as names, no names at all.
Units are told in two ways, by a list of common ones and by place: any word behind a number. This makes up to six readings.
A reading with fewer than ``LITERALS`` words says too little and is replaced by the window word for word. Names of several words are one
token in a second cut of a text, made where it differs.

Windows of ``width`` tokens of the benchmark are joined with the windows of the documents by the hash of any reading. A
document's window is formed only where it can match: at the places of the benchmark window's anchor, its longest word, found by an
equi-join on words. A window without a word of ``INFORMATIVE`` letters is found by two neighbouring words instead, where it has such.

The placeholders of a matched window are slots. An occurrence of an item is where its windows lie at one distance from
their places in the item. Its windows count only where its slots are consistent: one value of the benchmark's slot always
stands for one value in the occurrence (its most frequent partner, ties to the larger). A document is contaminated by an item if at least
``least`` of the item's windows match so, or all if it has fewer.

Edge cases: items shorter than ``width`` tokens are one window of all their tokens; null or empty texts and items match nothing; an item
of punctuation alone matches nothing; repeated rows and items give one result for each doc_id and item_id; with an empty benchmark or no
documents nothing is contaminated; rows without doc_id or item_id are matched too; texts of any length are cut in one piece; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

WIDTH, LEAST = 8, 3
#: Words besides placeholders that a reading has at least.
LITERALS = 3
#: Letters from which on a single word is rare enough to look windows up by.
INFORMATIVE = 6
#: Rows of benchmark windows up to which they are broadcast (after counting them); beyond, the join is shuffled.
BROADCAST_WINDOWS = 500_000
#: Units of measurement.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "mi", "g", "kg", "mg", "lb", "oz", "s", "sec", "min", "h", "hr", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "l", "ml", "litre", "litres", "liter", "liters", "meter", "meters", "metre", "metres", "mile", "miles", "dollar", "dollars", "euro", "euros", "cent", "cents", "kmh", "mph", "percent"]
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’*#&%$|"
NUMBER = r"^[+-]?\p{N}[\p{N}.,:/]*\p{L}{0,3}$"
NAME = r"^\p{Lu}\p{Ll}+(?:[_'’-]\p{L}+)*$"
#: A capitalised word and the white space before another one, which a second cut of the text takes for part of a name.
WITHIN_NAME = r"(?<![^\s(\"“])(\p{Lu}\p{Ll}+)\s+(?=\p{Lu}\p{Ll})"


def words(text: str | Column) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+")


def cuts(text: str) -> Column:
    """The text itself and, where that differs, with its names of several words as one."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return F.array_distinct(F.array(plain, F.when(plain.rlike(WITHIN_NAME), F.regexp_replace(plain, WITHIN_NAME, "$1_")).otherwise(plain)))


def literal(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(EDGES))


def classified(tokens: Column) -> Column:
    """For each token of a window its lower-case form, and whether it is a number, a known unit, a word behind a number or
    capitalised, and opens a sentence."""
    def one(w: Column, i: Column) -> Column:
        bare, before = F.btrim(w, F.lit(EDGES)), F.when(i == 0, F.lit("")).otherwise(F.get(tokens, i - 1))
        low, behind = F.lower(bare), F.btrim(before, F.lit(EDGES)).rlike(NUMBER)
        return F.struct(low.alias("low"), low.rlike(NUMBER).alias("number"), (behind & low.isin(*UNITS)).alias("unit"), (behind & low.rlike(r"^\p{L}+$")).alias("placed"),
                        bare.rlike(NAME).alias("name"), before.rlike(r"(^|[.!?][^\p{L}\p{N}]*)$").alias("opens"))

    return F.transform(tokens, one)


def readings(told: str) -> Column:
    """The template arrays of a window, of its ``classified`` tokens."""
    def reading(is_name, unit: str) -> Column:
        return F.transform(told, lambda x: F.when(x["number"], "<num>").when(x[unit], "<unit>").when(is_name(x), "<name>").otherwise(x["low"]))

    named = [lambda x: x["name"] & ~x["opens"], lambda x: x["name"], lambda x: F.lit(False)]
    every = F.array(*[reading(n, u) for u in ("unit", "placed") for n in named])
    telling = F.transform(every, lambda t: F.when(F.size(F.filter(t, lambda w: (F.length(w) > 0) & ~w.startswith("<"))) >= LITERALS, t).otherwise(F.transform(told, lambda x: x["low"])))
    return F.array_distinct(telling)


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, cut, windows of the item that can match, at, tokens, templates, anchor (one word or two) and its place in the window."""
    items = benchmark.select("item_id", F.posexplode(cuts("text")).alias("cut", "text")).select("item_id", "cut", F.filter(words("text"), lambda w: w != "").alias("w")).filter(F.size("w") > 0).distinct()
    n = F.greatest(F.size("w") - width + 1, F.lit(1))
    rows = items.select("item_id", "cut", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).withColumn("tokens", F.slice("w", F.col("at") + 1, F.lit(width))).drop("w")
    rows = rows.withColumn("told", classified(F.col("tokens"))).withColumn("templates", F.explode(readings("told"))).drop("told")
    plain = F.filter(F.transform("templates", lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))), lambda s: ~s["t"].startswith("<") & (s["n"] > 0))
    rows = rows.withColumn("plain", plain).withColumn("best", F.array_max("plain")).filter(F.col("best").isNotNull())
    rows = rows.withColumn("next", F.array_max(F.filter("plain", lambda s: s["i"] != F.col("best.i"))))
    # neighbours: two words side by side, the longest of them
    literals = lambda i: ~F.get("templates", i).startswith("<") & (F.length(F.get("templates", i)) > 0)
    two = F.transform("templates", lambda t, i: F.when(literals(i) & literals(i + 1), F.struct((F.length(t) + F.length(F.get("templates", i + 1))).alias("n"), (-i).alias("i"), F.concat_ws(" ", t, F.get("templates", i + 1)).alias("t"))))
    rows = rows.withColumn("key", F.when(F.col("best.n") < INFORMATIVE, F.array_max(two))).withColumn("key", F.coalesce("key", "best"))
    rows = rows.withColumn("windows", F.size(F.collect_set("at").over(Window.partitionBy("item_id", "cut"))))
    return rows.select("item_id", "cut", "windows", "at", "tokens", "templates", F.col("key.t").alias("anchor"), (-F.col("key.i")).alias("offset"), (-F.col("next.i")).alias("offset2"), F.col("next.t").alias("word2"), F.xxhash64(F.array_join("templates", " ")).alias("window"))


def candidate_windows(docs: DataFrame, known: DataFrame, small: bool) -> DataFrame:
    """doc_id, cut, start and own (tokens) of each window of the documents that stands at a benchmark window's anchor."""
    cut = docs.select("doc_id", F.posexplode(cuts("text")).alias("cut", "text")).select("doc_id", "cut", F.xxhash64("text").alias("key"), words("text").alias("w"))
    # shorter words than the first of every anchor needn't be looked at; the outer explode keeps the optimiser from splitting each text a second time for a filter on its words
    shape = known.agg(F.coalesce(F.min(F.length(F.split_part("anchor", F.lit(" "), F.lit(1)))), F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("anchor").contains(" ")), F.lit(False)).alias("pairs")).first()
    carried = ["w"] if small else []
    told = cut.select("doc_id", "cut", "key", "w", F.posexplode_outer("w").alias("pos", "word")).filter(F.length("word") >= shape["n"])
    if shape["pairs"]:
        anchors = F.explode(F.array(literal(F.col("word")), F.concat(literal(F.col("word")), F.lit(" "), literal(F.get("w", F.col("pos") + 1)))))
        told = told.select("doc_id", "cut", "key", *carried, "pos", anchors.alias("anchor"))
    else:
        told = told.select("doc_id", "cut", "key", *carried, "pos", literal(F.col("word")).alias("anchor"))
    place = F.struct("offset", F.size("tokens").alias("n"), "offset2", "word2")
    start = (F.col("pos") - F.col("p.offset")).cast("int")
    if small:
        places = F.broadcast(known.groupBy("anchor").agg(F.collect_set(place).alias("places")))
        met = told.join(places, "anchor").select("doc_id", "cut", "w", "pos", F.explode("places").alias("p")).withColumn("start", start)
    else:  # only numbers are shuffled by anchor; the words come back by the text's key
        met = told.join(known.select("anchor", place.alias("p")).distinct(), "anchor").select("doc_id", "cut", "key", start.alias("start"), "p").filter("start >= 0").distinct()
        left, right = met.alias("m"), cut.dropDuplicates(["doc_id", "cut", "key"]).alias("c")
        met = left.join(right, F.col("m.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("m.cut") == F.col("c.cut")) & (F.col("m.key") == F.col("c.key"))).select("m.doc_id", "m.cut", "c.w", "m.start", "m.p")
    second = F.col("p.word2").isNull() | (literal(F.get("w", F.col("start") + F.col("p.offset2"))) == F.col("p.word2"))  # a cheap look first
    return met.filter((F.col("start") >= 0) & (F.col("start") + F.col("p.n") <= F.size("w")) & second).select("doc_id", "cut", "start", F.slice("w", F.col("start") + 1, F.col("p.n")).alias("own"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows (matched and consistent), item_windows and n_slots of each contaminated document."""
    known = saved(benchmark_windows(benchmark, width), "benchmark_windows")
    small = known.count() <= BROADCAST_WINDOWS
    sent = F.broadcast if small else lambda df: df
    inside = candidate_windows(docs, known, small).withColumn("told", classified(F.col("own")))
    hashed = inside.withColumn("own_templates", F.explode(readings("told"))).drop("told").withColumn("window", F.xxhash64(F.array_join("own_templates", " ")))
    # a plain equality would put a null check of the templates into the filter on windows, out of generated code, so that
    # each meeting with an anchor would copy its document's words
    same = F.col("own_templates").eqNullSafe(F.col("templates"))
    pairs = hashed.join(sent(known.select("item_id", F.col("cut").alias("item_cut"), "windows", "at", "tokens", "templates", "window")), "window").filter(same)
    slots = F.filter(F.zip_with(F.zip_with("templates", "tokens", lambda t, b: F.struct(t.alias("t"), literal(b).alias("b"))), "own", lambda x, o: F.struct(x["t"].alias("t"), x["b"].alias("b"), literal(o).alias("o"))), lambda x: x["t"].startswith("<"))
    place = ["doc_id", "item_id", "cut", "item_cut", "base"]
    found = saved(pairs.select("doc_id", "item_id", "cut", "item_cut", "windows", "at", (F.col("start") - F.col("at")).alias("base"), slots.alias("slots")).distinct(), "window_matches")
    # each slot value's most frequent partner in the occurrence; windows that say otherwise don't count
    said = found.select(*place, F.explode("slots").alias("s")).groupBy(*place, "s.t", "s.b", "s.o").agg(F.count("*").alias("n"))
    partner = said.groupBy(*place, "t", "b").agg(F.max(F.struct("n", "o"))["o"].alias("o")).groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "t", "b"), "o"))).alias("partners"))
    left, right, on = found.alias("f"), partner.alias("p"), F.lit(True)
    for c in place:
        on = on & F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}"))
    both = left.join(right, on, "left").select("f.*", "p.partners")
    steady = both.filter(F.forall("slots", lambda s: F.coalesce(F.element_at("partners", F.concat_ws(":", s["t"], s["b"])) == s["o"], F.lit(True))))
    counted = steady.groupBy("doc_id", "item_id", "item_cut").agg(F.countDistinct("at").alias("n_windows"), F.max("windows").cast("long").alias("item_windows"), F.max(F.size("slots")).cast("long").alias("n_slots"))
    counted = counted.filter(F.col("n_windows") >= F.least(F.lit(least), F.col("item_windows")))
    most = F.max(F.struct("n_windows", "item_windows", "n_slots"))
    return counted.groupBy("doc_id", "item_id").agg(most.alias("m")).select("doc_id", "item_id", "m.n_windows", "m.item_windows", "m.n_slots")
