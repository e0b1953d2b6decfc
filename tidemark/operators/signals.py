"""Popularity series with decay, thresholds, and noise / weak / strong labels.

Dates are DATE columns. ``log``: merge_ts, topic1, topic2, document_count1, document_count2, count1, count2, source2 (array).
``series``: topic, seq, ts, popularity, docs_count, paragraphs_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.written import save


def events(log: DataFrame, g: int, snap_to_grid: bool = False) -> DataFrame:
    """The steps of each topic in order: topic, step, kind (0 first, 1 merge, 2 idle), topic2, ts, amount, paragraphs, n.

    A merge logged at m shows at m + g. After the last merge before a later one at M, idle steps run over (m + 2g, M - 2g);
    after the topic's last merge up to the end of the grid. Merges off the grid are ignored (or moved down to it).
    """
    span = log.agg(F.min("merge_ts").alias("first"), F.max("merge_ts").alias("last"))
    rows = log.crossJoin(F.broadcast(span))
    off = F.pmod(F.datediff("merge_ts", "first"), F.lit(g))
    rows = rows.withColumn("merge_ts", F.date_sub("merge_ts", off)) if snap_to_grid else rows.filter(off == 0)
    end = F.date_add(F.date_sub("last", F.pmod(F.datediff("last", "first"), F.lit(g))), F.when(F.pmod(F.datediff("last", "first"), F.lit(g)) == 0, g).otherwise(g))
    in_time = Window.partitionBy("topic1").orderBy("merge_ts", "topic2")
    rows = rows.withColumn("place", F.row_number().over(in_time)).withColumn("after", F.lead("merge_ts").over(in_time))
    first = rows.filter("place = 1").select(F.col("topic1").alias("topic"), F.col("merge_ts").alias("step"), F.lit(0).alias("kind"), F.lit(-1).alias("topic2"), F.col("merge_ts").alias("ts"), F.col("document_count1").alias("amount"), F.col("count1").alias("paragraphs"), F.lit(0).alias("n"))
    merge = rows.select(F.col("topic1").alias("topic"), F.col("merge_ts").alias("step"), F.lit(1).alias("kind"), F.col("topic2").cast("int").alias("topic2"), F.date_add("merge_ts", g).alias("ts"), F.col("document_count2").alias("amount"), F.col("count2").alias("paragraphs"), F.lit(0).alias("n"))
    until = F.when(F.col("after").isNull(), end).otherwise(F.date_sub("after", 2 * g))
    steps = F.floor(F.datediff(until, F.date_add("merge_ts", g)) / g).cast("int")
    idle = rows.filter("after is null or after != merge_ts").withColumn("steps", steps).filter("steps >= 1").withColumn("n", F.explode(F.sequence(F.lit(1), "steps"))).withColumn("ts", F.date_add("merge_ts", F.lit(g) * (F.col("n") + 1)))
    idle = idle.select(F.col("topic1").alias("topic"), F.col("ts").alias("step"), F.lit(2).alias("kind"), F.lit(-1).alias("topic2"), "ts", F.lit(0).cast("long").alias("amount"), F.lit(0).cast("long").alias("paragraphs"), "n")
    return first.unionByName(merge).unionByName(idle)


def decayed_totals(rows: DataFrame, key: str, order: list[str], amount: str, decay: str, out: str = "popularity") -> DataFrame:
    """``out``: what has come in up to each row, each amount shrunk by e to the power of all decays after it.

    That is a running sum of amount * e**D, over e**D, with D the running sum of decays. D is counted from marks 500
    apart, so that no power overflows; what lies two marks back is beyond the range of doubles.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__d", F.sum(decay).over(upto)).withColumn("__mark", F.floor(F.col("__d") / 500))
    rows = rows.withColumn("__x", F.col(amount) * F.exp(F.col("__d") - 500 * F.col("__mark")))
    within = Window.partitionBy(key, "__mark").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("__mark").rangeBetween(-1, -1)
    here, back = F.sum("__x").over(within), F.coalesce(F.sum("__x").over(before), F.lit(0.0))
    total = here * F.exp(500 * F.col("__mark") - F.col("__d")) + back * F.exp(500 * (F.col("__mark") - 1) - F.col("__d"))
    return rows.withColumn(out, total).drop("__d", "__mark", "__x")


def signal_popularity(log: DataFrame, g: int, factor: float = 0.01, power: float = 2.0, snap_to_grid: bool = False) -> DataFrame:
    """The series of each topic that has a merge: it grows by a merge's documents and decays over idle steps, compounding."""
    order = ["step", "kind", "topic2", "ts", "n"]
    in_order = Window.partitionBy("topic").orderBy(*order)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decay = F.when(F.col("kind") == 2, factor * F.pow(F.col("n").cast("double"), F.lit(power))).otherwise(0.0)
    steps = events(log, g, snap_to_grid).withColumn("decay", decay).withColumn("documents", F.col("amount").cast("double"))
    steps = steps.withColumn("seq", F.row_number().over(in_order) - 1).withColumn("docs_count", F.sum("amount").over(upto).cast("long")).withColumn("paragraphs_count", F.sum("paragraphs").over(upto).cast("long"))
    return decayed_totals(steps, "topic", order, "documents", "decay").select("topic", "seq", "ts", "popularity", "docs_count", "paragraphs_count")


def in_windows(dates: DataFrame, rows: DataFrame, before: int, after: int) -> DataFrame:
    """All pairs of a date (eval_date) and a row with eval_date - before <= ts <= eval_date + after, as an equi-join.

    Time is cut into stretches as long as a window, so that a row lies in one and a window in two at most.
    """
    width, day = before + after + 1, F.unix_date("eval_date")
    wide = dates.withColumn("__stretch", F.explode(F.sequence(F.floor((day - before) / width), F.floor((day + after) / width))))
    met = rows.withColumn("__stretch", F.floor(F.unix_date("ts") / width)).join(wide, "__stretch").drop("__stretch")
    return met.filter((F.col("ts") >= F.date_sub("eval_date", before)) & (F.col("ts") <= F.date_add("eval_date", after)))


def window_sketches(points: DataFrame, dates: DataFrame, window: int, k: int) -> DataFrame:
    """eval_date, sketch, n_points: quantile sketches of each day's popularity, merged over the days of each date's window."""
    daily = points.groupBy("ts").agg(F.kll_sketch_agg_double("popularity", F.lit(k)).alias("sketch"), F.count("*").alias("n"))
    return in_windows(dates, daily, window, 0).groupBy("eval_date").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n_points"))


def exact_quantiles(runs: DataFrame, sketched: DataFrame, window: int, shares: dict[str, float], margin: float) -> DataFrame:
    """eval_date, n_points, a column for each of ``shares``, and ``sure``, false where a bracket missed.

    A sketch brackets the wanted values within ``margin`` of their rank; what lies below is only counted, what lies inside is ranked.
    ``runs``: ts, popularity, c (how often the value occurs that day).
    """
    def bracket(name: str, p: float) -> Column:
        ends = (F.lit(float("-inf")), F.lit(float("inf"))) if margin >= 1 else (F.kll_sketch_get_quantile_double("sketch", F.lit(float(min(1, max(0, x))))) for x in (p - margin, p + margin))
        return F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), *(e.alias(c) for e, c in zip(ends, ("low", "high"))))

    wide = sketched.select("eval_date", "n_points", F.explode(F.array(*(bracket(*s) for s in shares.items()))).alias("b")).select("eval_date", "n_points", "b.*")
    met = in_windows(wide, runs, window, 0).filter(F.col("popularity") <= F.col("high"))
    value = F.when(F.col("popularity") >= F.col("low"), F.col("popularity"))  # null below, where only the number counts
    counted = met.groupBy("eval_date", "name", "p", "n_points", value.alias("v")).agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("eval_date", "name").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.col("p") * (F.col("n_points") - 1)
    at = lambda r: F.min(F.when(F.col("upto") >= r + 1, F.col("v")))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
    found = counted.withColumn("upto", upto).withColumn("place", place).groupBy("eval_date", "name", "n_points", "place").agg(at(F.floor("place")).alias("v0"), at(F.ceil("place")).alias("v1"), below.alias("below"))
    sure = (F.col("below") <= F.floor("place")) & F.col("v1").isNotNull()
    found = found.select("eval_date", "name", "n_points", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("place") - F.floor("place"))).alias("value"), sure.alias("sure"))
    pivoted = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares]
    return found.groupBy("eval_date", "n_points").agg(*pivoted, ((F.count("*") == len(shares)) & F.every("sure")).alias("sure"))


def thresholds(series: DataFrame, dates: DataFrame, window: int, low: float = 0.10, high: float = 0.75, exact: bool = True, k: int = 800) -> DataFrame:
    """eval_date, q1, q3, n_points of the points in [date - window, date] with popularity over 1e-5; 0 where there are none.

    Sketches of the days are merged over the windows. With ``exact`` they only say where to look: the values that are interpolated
    are found by counting the days' values, so that no window meets in one task as a whole. Without it the sketches' own
    quantiles are given, whose ranks are off by about 2.3 / k ** 0.9 of all at most (with 99 % certainty).
    """
    points = series.filter("popularity > 1e-5").select("ts", "popularity")
    sketched = window_sketches(points, dates, window, k)
    shares = {"q1": low, "q3": high}
    if exact:
        runs = points.groupBy("ts", "popularity").agg(F.count("*").alias("c"))
        margin = 4.6 / k**0.9
        found = save(exact_quantiles(runs, sketched, window, shares, margin), "quantiles")
        while not (missed := found.filter("not sure").select("eval_date")).isEmpty():
            margin *= 8
            again = exact_quantiles(runs, sketched.join(missed, "eval_date", "left_semi"), window, shares, margin)
            found = save(found.filter("sure").unionByName(again), "quantiles")
    else:
        found = sketched.select("eval_date", "n_points", *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(c) for c, p in shares.items()))
    return dates.join(found, "eval_date", "left").select("eval_date", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in shares), F.coalesce("n_points", F.lit(0)).alias("n_points"))


def classify_signals(series: DataFrame, dates: DataFrame, g: int, window: int, include_next_period: bool = True, rising_only: bool = True, low: float = 0.10, high: float = 0.75) -> DataFrame:
    """eval_date, topic, popularity, latest_ts, docs_count, rising, category at each of ``dates`` (eval_date), in one job.

    A topic is noise under q1, strong above q3, else weak if it rises over its last 14 days, else noise.
    """
    ahead = g if include_next_period else 0
    last = in_windows(dates, series, window, ahead).groupBy("eval_date", "topic").agg(F.max(F.struct("seq", "ts", "popularity", "docs_count", "paragraphs_count")).alias("l"))
    last = last.join(thresholds(series, dates, window, low, high), "eval_date")
    p = F.col("l.popularity")
    told = last.select("eval_date", "topic", p.alias("popularity"), F.col("l.ts").alias("latest_ts"), F.col("l.seq").alias("latest"), F.col("l.docs_count").alias("docs_count"), F.col("l.paragraphs_count").alias("paragraphs_count"), "q1", "q3")
    near = in_windows(dates, series.select("topic", "ts", "seq", F.col("popularity").alias("value")), window + 14, ahead)
    near = near.join(told.select("eval_date", "topic", "latest_ts"), ["eval_date", "topic"]).filter((F.col("ts") <= F.col("latest_ts")) & (F.col("ts") >= F.date_sub("latest_ts", 14)))
    slope = near.groupBy("eval_date", "topic").agg(F.coalesce(F.regr_slope("value", F.col("seq").cast("double")) > 0, F.lit(True)).alias("rising"))
    middle = F.when(F.col("rising") | F.lit(not rising_only), "weak").otherwise("noise")
    category = F.when(F.col("popularity") < F.col("q1"), "noise").when(F.col("popularity") <= F.col("q3"), middle).otherwise("strong")
    return told.join(slope, ["eval_date", "topic"]).select("eval_date", "topic", "popularity", "latest_ts", "docs_count", "paragraphs_count", "rising", "q1", "q3", category.alias("category"))


def zeroshot_trend(info: DataFrame, names: DataFrame, g: int, factor: float = 0.01, power: float = 2.0) -> DataFrame:
    """name, ts, popularity on the full date grid: a seen period sets the count, missing ones decay, never seen stays 0.

    info: ts, name, document_count (dates off the grid are ignored).
    """
    span = info.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {g} days"))).alias("ts"))
    rows = names.crossJoin(F.broadcast(grid)).join(info.select("name", "ts", "document_count"), ["name", "ts"], "left")
    in_time = Window.partitionBy("name").orderBy("ts")
    rows = rows.withColumn("__k", F.row_number().over(in_time))
    idle = F.col("__k") - F.coalesce(F.last(F.when(F.col("document_count").isNotNull(), F.col("__k")), ignorenulls=True).over(in_time), F.lit(0))
    decay = F.when(F.col("document_count").isNull(), factor * F.pow(idle.cast("double"), F.lit(power))).otherwise(0.0)
    rows = rows.withColumn("decay", decay).withColumn("documents", F.coalesce(F.col("document_count").cast("double"), F.lit(0.0)))
    return decayed_totals(rows, "name", ["ts"], "documents", "decay").select("name", "ts", "popularity")


def source_diversity(rows: DataFrame) -> DataFrame:
    """topic, ts, diversity: distinct sources seen up to and with each date, from first-seen marks and a running sum."""
    first = rows.groupBy("topic", "source").agg(F.min("ts").alias("ts")).groupBy("topic", "ts").agg(F.count("*").alias("new"))
    dates = rows.select("topic", "ts").distinct().join(first, ["topic", "ts"], "left")
    return dates.select("topic", "ts", F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("topic").orderBy("ts")).alias("diversity"))


def sankey_links(log: DataFrame) -> DataFrame:
    """ts, source, destination, count of the merge flow; of equal links the one of smallest count stays."""
    dates = log.select("merge_ts").distinct().withColumn("idx", F.row_number().over(Window.orderBy("merge_ts")) - 1)
    dates = dates.withColumn("next_ts", F.coalesce(F.lead("merge_ts").over(Window.orderBy("merge_ts")), "merge_ts"))
    rows = log.join(F.broadcast(dates), "merge_ts")
    later = rows.select("topic1", "idx").distinct().withColumn("next_idx", F.lead("idx").over(Window.partitionBy("topic1").orderBy("idx")))
    within = Window.partitionBy("merge_ts", "topic1").orderBy("topic2")
    rows = rows.join(later, ["topic1", "idx"]).withColumn("merged", F.first("document_count1").over(within) + F.sum("document_count2").over(within))
    to = F.when(F.col("next_idx").isNotNull(), F.concat_ws("_", "next_idx", F.lit("1"), "topic1")).otherwise(F.concat_ws("_", "idx", F.lit("1"), "topic1", F.lit("new")))
    links = rows.select(F.explode(F.array(
        F.struct(F.col("merge_ts").alias("ts"), F.concat_ws("_", "idx", F.lit("1"), "topic1").alias("source"), to.alias("destination"), F.col("document_count1").alias("count")),
        F.struct(F.col("next_ts").alias("ts"), F.concat_ws("_", "idx", F.lit("2"), "topic2").alias("source"), to.alias("destination"), F.col("merged").alias("count")))).alias("l")).select("l.*")
    return links.groupBy("ts", "source", "destination").agg(F.min("count").alias("count"))


def connected(links: DataFrame, seeds: DataFrame, save) -> DataFrame:
    """Links whose nodes are connected (either way) to a seed node; a written frontier a round, until nothing is new."""
    edges = save(links.select(F.col("source").alias("a"), F.col("destination").alias("b")).union(links.select("destination", "source")).distinct(), "edges")
    reached, size = save(seeds.select("node").distinct(), "reached"), -1
    while (n := reached.count()) != size:
        size = n
        reached = save(reached.union(edges.join(reached, edges["a"] == reached["node"]).select(F.col("b").alias("node"))).distinct(), "reached")
    return links.join(reached, links["source"] == reached["node"], "left_semi")
