"""Operator 2: personal data and the terms that give protected entities away, in DataFrame functions only.

Base spans come from four fixed patterns with their checks (address parts, Luhn, digit counts). Every e-mail, address,
card and phone number found is a protected entity, and so is each match of further patterns that the caller names in ``protected``
(names of persons, customer numbers). The information-theoretic part asks the corpus how strongly a term
reveals an entity: over the words around all mentions it estimates p(entity | term) and the information
log2(p(entity | term) / p(entity)). Terms are words of any length. A term discloses an entity if the posterior is at least ``posterior``, the
information at least ``bits`` and the two have met in at least ``support`` different contexts (copies of a passage are
one context). Its occurrences in all documents are spans of kind ``term``. An entity that the corpus mentions in fewer contexts
has no disclosing terms.

``sanitise`` replaces spans: base spans become a placeholder of their kind. Disclosing terms are generalised step by step, the
further the more they tell: to their kind (``[NAME]`` or ``[WORD]``), from ``general`` on to ``[TERM]``, and from ``removal`` on they are removed.

Only keys and terms are joined; a text with disclosing terms is fetched once, by its key.

Edge cases: a null text is an empty one; repeated rows each get their spans; rows without doc_id are kept; terms inside a
base span add no span; texts of any length are searched whole; further columns pass through ``sanitise`` and are ignored elsewhere;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, saved

#: Fixed patterns of the contract. A run of name characters is entered at its start or where the last match ended, and
#: repetitions are possessive where nothing could be given back, so that matching stays linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Characters on each side of a mention whose words count as its context.
CONTEXT = 80
BLOCK = 64
#: Disclosing terms up to which they are broadcast (after counting them); beyond, the join is shuffled.
BROADCAST_TERMS = 200_000
SPANS = "array<struct<kind:string,start:bigint,stop:bigint,value:string>>"
EXTRA = "array<struct<kind:string,start:bigint,stop:bigint,value:string,posterior:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    d = F.reverse(digits(x))
    at = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(at, F.lit(0), lambda a, i: a + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return F.length(d).between(16, 19) & (total % 10 == 0)


def fine(kind: str, x: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {"email": F.lit(True), "ip": x.rlike(rf"^{part}(?:\.{part}){{3}}$"), "card": luhn(x), "phone": F.length(digits(x)).between(8, 15)}[kind]


def located(df: DataFrame, kind: str, pattern: str | Column, guard: Column, check, out: str) -> DataFrame:
    """Add ``out``: the spans (kind, start, stop, value) of a pattern's matches in ``text``, in code points.

    The text between matches comes from split, the matches from regexp_extract_all; starts are running sums of both
    lengths, taken in blocks so that many matches in one text stay cheap.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    zero = F.lit(0).cast("long")
    df = df.withColumn("__m", F.when(guard, F.regexp_extract_all("text", regex, F.lit(0))))
    df = df.withColumn("__p", F.when(F.size("__m") > 0, F.split("text", regex, -1)))
    df = df.withColumn("__s", F.when(F.col("__p").isNotNull(), F.zip_with(F.slice("__p", F.lit(1), F.size("__m")), "__m", lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("own"), m.alias("value")))))
    add = lambda a, s: a + s["gap"] + s["own"]
    some = F.col("__s").isNotNull()
    df = df.withColumn("__k", F.when(some, F.transform(F.sequence(F.lit(0), F.floor(F.size("__s") / BLOCK).cast("int")), lambda b: F.slice("__s", b * BLOCK + 1, BLOCK))))
    df = df.withColumn("__b", F.when(some, F.transform("__k", lambda block: F.aggregate(block, zero, add))))
    df = df.withColumn("__c", F.when(some, F.transform("__b", lambda x, i: F.aggregate(F.slice("__b", F.lit(1), i), zero, lambda a, y: a + y))))

    def spans_of(block: Column, before: Column) -> Column:
        def span(s: Column, i: Column) -> Column:
            start = before + F.aggregate(F.slice(block, F.lit(1), i), zero, add) + s["gap"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + s["own"]).alias("stop"), s["value"].alias("value"))

        return F.transform(block, span)

    spans = F.filter(F.flatten(F.zip_with("__k", "__c", spans_of)), lambda x: check(x["value"]))
    none = F.array().cast(SPANS)
    return df.withColumn(out, F.coalesce(F.when(some, spans), none)).drop("__m", "__p", "__s", "__k", "__b", "__c")


def joined(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def base_spans(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and ``base``, the spans of the four kinds as listed, each by start."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    guards = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": t.contains("+")}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        df = located(df, kind, pattern, guards[kind], partial(fine, kind), f"__{kind}")
    return df.withColumn("base", F.concat(*(f"__{k}" for k in KINDS))).drop(*(f"__{k}" for k in KINDS))


def terms(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def mentions(base: Column, text: Column) -> Column:
    """For each span the entity and the distinct terms around it, without the words cut off at the window's ends."""
    def one(s: Column) -> Column:
        entity = F.concat_ws(":", s["kind"], F.when(s["kind"].isin("card", "phone"), digits(s["value"])).otherwise(F.lower(s["value"])))
        left = F.least(s["start"], F.lit(CONTEXT))
        before = F.regexp_replace(F.substring(text, (s["start"] - left + 1).cast("int"), left.cast("int")), r"^\p{L}+", "")
        after = F.regexp_replace(F.substring(text, (s["stop"] + 1).cast("int"), F.lit(CONTEXT)), r"\p{L}+$", "")
        return F.struct(entity.alias("entity"), F.array_distinct(F.concat(terms(before), terms(after))).alias("terms"))

    return F.transform(base, one)


def disclosing_terms(found: DataFrame, docs: DataFrame, posterior: float = 0.5, bits: float = 4.0, support: int = 3) -> DataFrame:
    """term, entity, posterior and information of all terms beyond the thresholds.

    ``found`` has the mentions; the terms are counted over all texts of ``docs``, summed up in each task before they meet.
    """
    around = found.select(F.explode("mentions").alias("m")).select("m.entity", "m.terms").withColumn("context", F.xxhash64("terms"))
    contexts = around.groupBy("entity", "context").agg(F.count("*").alias("n"))
    often = contexts.groupBy("entity").agg(F.sum("n").alias("mentions"), F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
    often = saved(often.select("entity", "mentions", F.col("mentions").alias("n")), "entities")
    told = often.agg(F.sum("n").alias("n")).first()["n"]
    none = often.select(F.lit("").alias("term"), "entity", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("information")).filter("false")
    if told is None:
        return none
    met = attach(around, often, ["entity"], "n", told).filter("mentions is not null").select("entity", "mentions", "context", F.explode("terms").alias("term"))
    pairs = saved(met.groupBy("entity", "term").agg(F.first("mentions").alias("mentions"), F.count("*").alias("together"), F.countDistinct("context").alias("contexts")).filter(F.col("contexts") >= support), "pairs")
    if pairs.isEmpty():
        return none
    counted = docs.select(F.explode_outer(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = found.count()
    p = F.col("together") / F.greatest("n", "together")
    told = pairs.join(counted, "term").select("term", "entity", p.alias("posterior"), F.log2(p / (F.col("mentions") / total)).alias("information"))
    return saved(told.filter((F.col("posterior") >= posterior) & (F.col("information") >= bits)), "disclosing")


def find_spans(docs: DataFrame, protected: dict[str, str] | None = None, **thresholds: float) -> DataFrame:
    """doc_id, h (hash of the text), base and extra, the spans of disclosing terms, for each row of ``docs``."""
    based = base_spans(docs.select("doc_id", "text"))
    entities = ["base"]
    for i, (kind, pattern) in enumerate((protected or {}).items()):
        based = located(based, kind, pattern, F.lit(True), lambda x: F.lit(True), f"__entity{i}")
        entities.append(f"__entity{i}")
    found = saved(based.select("doc_id", F.xxhash64("text").alias("h"), "base", mentions(F.concat(*entities), F.col("text")).alias("mentions")), "base_spans")
    revealing = disclosing_terms(found, docs, **thresholds).groupBy("term").agg(F.max("posterior").alias("posterior"))
    told, n = found.select("doc_id", "h", "base"), revealing.count()
    if not n:
        return told.withColumn("extra", F.array().cast(EXTRA))
    text = F.coalesce("text", F.lit(""))
    full = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    words = full.select("doc_id", "h", F.explode(F.array_distinct(terms("text"))).alias("term"))
    hits = words.join(F.broadcast(revealing) if n <= BROADCAST_TERMS else revealing, "term").distinct()
    by_key = hits.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("term", "posterior"))).alias("known"))
    by_key = saved(by_key.withColumnsRenamed({"doc_id": "__id", "h": "__h"}), "hits")
    placed = full.join(by_key, full["doc_id"].eqNullSafe(by_key["__id"]) & (full["h"] == by_key["__h"])).select("__id", "__h", "text", "known")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("known"), "|"), F.lit(r")(?!\p{L})"))
    placed = located(placed, "term", pattern, F.lit(True), lambda x: F.lit(True), "spans")
    extra = F.transform("spans", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), F.coalesce(F.element_at("known", F.lower(x["value"])), F.lit(0.0)).alias("posterior")))
    by_text = saved(placed.select("__id", "__h", extra.alias("x")).dropDuplicates(["__id", "__h"]), "term_spans")
    both = told.join(by_text, told["doc_id"].eqNullSafe(by_text["__id"]) & (told["h"] == by_text["__h"]), "left")
    clear = F.filter("x", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (b["stop"] > x["start"])))
    return both.select("doc_id", "h", "base", F.coalesce(clear, F.array().cast(EXTRA)).alias("extra"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans and all spans as text."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    both = F.array_join(F.filter(F.array(joined("base"), joined("extra")), lambda x: x != ""), ",")
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), both.alias("spans"), F.size("extra").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, general: float = 0.7, removal: float = 0.9, protected: dict[str, str] | None = None, **thresholds: float) -> DataFrame:
    """``docs`` with the spans taken out of ``text``; overlapping spans are replaced as one. Other columns pass through, whatever their names."""
    names = docs.columns
    held = {c: f"__own{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    docs = docs.withColumnsRenamed(held)
    extra = find_spans(docs, protected, **thresholds).filter(F.size("extra") > 0).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "extra").dropDuplicates(["__id", "__h"])
    based = base_spans(docs)
    found = based.join(extra, based["doc_id"].eqNullSafe(extra["__id"]) & (F.xxhash64(based["text"]) == extra["__h"]), "left").drop("__id", "__h").withColumn("extra", F.coalesce("extra", F.array().cast(EXTRA)))

    def generalised(s: Column) -> Column:
        named = F.when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(s["posterior"] >= removal, "").when(s["posterior"] >= general, "[TERM]").otherwise(named)

    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    extra = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), generalised(s).alias("by")))
    df = found.withColumn("__all", F.array_sort(F.concat(base, extra)))
    kind = "array<struct<start:bigint,stop:bigint,by:string>>"

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["by"].alias("by"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] > s["start"]), wider).otherwise(F.concat(done, F.array(s)))

    df = df.withColumn("__all", F.when(F.size("__all") > 0, F.aggregate("__all", F.array().cast(kind), merge)))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("__all", lambda s: s["stop"]))
    df = df.withColumn("__ends", ends)
    cut = lambda start, n: F.substring(F.col("text"), (start + 1).cast("int"), n.cast("int"))
    parts = F.transform("__all", lambda s, i: F.concat(cut(F.element_at("__ends", i + 1), s["start"] - F.element_at("__ends", i + 1)), s["by"]))
    rest = cut(F.element_at("__ends", -1), F.length("text").cast("long"))
    return df.withColumn("text", F.when(F.col("__all").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest))).select(*(F.col(held.get(c, c)).alias(c) for c in names))
