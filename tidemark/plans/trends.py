"""Queries on topics, joins, aggregations and the trend core."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import jobs, merging, signals as S, topics as O
from tidemark.operators.written import save, scratch
from tidemark.plans.bindings import ACTIVITY, DAYS, DOCS, KINDS, SIMILARITY, VECTORS, activity, documents, kinds, query, table, vectors

G = 2


# ---- joins and topic frames


@query(f"WITH {VECTORS} SELECT d.document_id, topic, d.source, d.url FROM docs d LEFT JOIN vecs v USING (document_id)")
def attach_topic_to_paragraphs(spark, sf_dir):
    v = vectors(spark, sf_dir).select("document_id", "topic")
    return documents(spark, sf_dir).join(v, "document_id", "left").select("document_id", "topic", "source", "url")


INFO = "info AS (SELECT period, topic, count(*) AS count, count(DISTINCT document_id) AS document_count, list_sort(list(DISTINCT source)) AS sources FROM vecs GROUP BY period, topic)"


@query(f"WITH {VECTORS}, {INFO} SELECT period, topic, count, document_count, array_to_string(sources, ',') AS sources FROM info")
def topic_info(spark, sf_dir):
    return O.topic_info(vectors(spark, sf_dir)).select("period", "topic", "count", "document_count", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {VECTORS}, {INFO} SELECT DISTINCT period, topic, document_count, len(sources) AS n_sources, url FROM info JOIN vecs USING (period, topic)")
def topic_info_enrich(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return O.topic_info(v).select("period", "topic", "document_count", F.size("sources").cast("long").alias("n_sources")).join(O.topic_urls(v), ["period", "topic"])


CENTROIDS = """cent AS (SELECT period, topic, list(m ORDER BY i) AS c FROM (SELECT period, topic, i, avg(embedding[i]) AS m FROM vecs, range(1, 65) AS r(i) WHERE topic != -1 GROUP BY period, topic, i) GROUP BY period, topic)"""


@query(f"WITH {VECTORS}, {CENTROIDS} SELECT period, topic, round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM cent")
def topic_centroid(spark, sf_dir):
    c = V.mean_vector(vectors(spark, sf_dir).filter("topic != -1"), ["period", "topic"], "embedding", "c")
    return c.select("period", "topic", F.round(F.element_at("c", 1), 6).alias("first"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {VECTORS}, {CENTROIDS}, {INFO} SELECT i.period, i.topic, i.count, i.document_count, round(c[2], 6) AS second FROM info i JOIN cent USING (period, topic)")
def period_topics(spark, sf_dir):
    return O.period_topics(vectors(spark, sf_dir)).select("period", "topic", "count", "document_count", F.round(F.element_at("embedding", 2), 6).alias("second"))


@query(f"""WITH {VECTORS}, {CENTROIDS} SELECT a.topic AS topic1, b.topic AS topic2, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM cent a, cent b
WHERE a.period = (SELECT min(period) FROM cent) AND b.period = (SELECT min(period) FROM cent) + {DAYS} QUALIFY row_number() OVER (PARTITION BY b.topic ORDER BY list_cosine_similarity(a.c, b.c) DESC, a.topic) = 1""")
def similarity_join_topics(spark, sf_dir):
    first, second = _two_periods(spark, sf_dir)
    got = O.best_match(second.withColumnRenamed("topic", "topic2"), first.withColumnRenamed("topic", "topic1"), "topic2", "topic1", "embedding", "embedding")
    return got.select("topic1", "topic2", F.round("similarity", 6).alias("similarity"))


def _two_periods(spark, sf_dir):
    """The topics of the first two periods, of whose rows alone they are made."""
    rows = vectors(spark, sf_dir)
    start = rows.filter("topic != -1").agg(F.min("period").alias("p0"))
    both = save(rows.join(F.broadcast(start), F.col("period").isin(F.col("p0"), F.date_add("p0", DAYS))).withColumn("second", F.col("period") != F.col("p0")).drop("p0"), "two_periods")
    return (O.period_topics(both.filter(F.col("second") == k)).drop("period") for k in (False, True))


MERGE = f"""{VECTORS}, {CENTROIDS}, {INFO}, p AS (SELECT min(period) AS p0 FROM cent), one AS (SELECT topic, c FROM cent, p WHERE period = p0), two AS (SELECT topic, c FROM cent, p WHERE period = p0 + {DAYS}),
near AS (SELECT two.topic AS topic2, one.topic AS topic1, list_cosine_similarity(one.c, two.c) AS s FROM one, two QUALIFY row_number() OVER (PARTITION BY two.topic ORDER BY list_cosine_similarity(one.c, two.c) DESC, one.topic) = 1)"""


@query(f"""WITH {MERGE}, d AS (SELECT topic, document_count, period FROM info), m AS (SELECT topic1, topic2, document_count AS dc FROM near, d, p WHERE s >= {SIMILARITY} AND d.topic = topic2 AND d.period = p0 + {DAYS}),
b AS (SELECT (SELECT max(topic) FROM one) + row_number() OVER (ORDER BY topic2) AS topic, document_count FROM near, d, p WHERE s < {SIMILARITY} AND d.topic = topic2 AND d.period = p0 + {DAYS})
SELECT CAST(topic AS BIGINT) AS topic, CAST(document_count AS BIGINT) AS document_count FROM b UNION ALL
SELECT o.topic, CAST(d.document_count + coalesce((SELECT sum(dc) FROM m WHERE topic1 = o.topic), 0) AS BIGINT) FROM one o JOIN d ON d.topic = o.topic, p WHERE d.period = p0""")
def merge_step(spark, sf_dir):
    first, second = _two_periods(spark, sf_dir)
    registry = first.select(F.col("topic").cast("long").alias("topic"), F.lit("2024-01-01").cast("date").alias("birth"), "embedding", "count", "document_count", "sources")
    return merging.merge_step(registry, second, "2024-01-01", SIMILARITY)[0].select("topic", "document_count")


@query()
def merge_all_periods(spark, sf_dir):
    _, log = merging.merge_all_periods(O.period_topics(vectors(spark, sf_dir)), SIMILARITY, save)
    return log.select("merge_ts", "topic1", "topic2", F.round("similarity", 6).alias("similarity"), "document_count1", "document_count2")


@query(f"""WITH {VECTORS}, {CENTROIDS} SELECT a.period, a.topic AS topic1, b.topic AS topic2, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM cent a JOIN cent b ON a.period = b.period AND a.topic < b.topic WHERE list_cosine_similarity(a.c, b.c) >= 0.05""")
def same_time_topic_pairs(spark, sf_dir):
    t = O.period_topics(vectors(spark, sf_dir)).select("period", "topic", "embedding")
    other = t.select(F.col("period").alias("p2"), F.col("topic").alias("topic2"), F.col("embedding").alias("e2"))
    pairs = t.join(other, (F.col("period") == F.col("p2")) & (F.col("topic") < F.col("topic2")))
    return pairs.select("period", F.col("topic").alias("topic1"), "topic2", V.cosine(F.col("embedding"), F.col("e2")).alias("s")).filter("s >= 0.05").select("period", "topic1", "topic2", F.round("s", 6).alias("similarity"))


# ---- the activity stream as a merge log, its series and labels

LOG = f"""{KINDS}, counts AS (SELECT topic, CAST(day - CAST((day - DATE '2024-01-01') % {G} AS INTEGER) AS DATE) AS period, count(*) AS c, count(DISTINCT document_id) AS d FROM kinds GROUP BY ALL),
log AS (SELECT CAST(period - {G} AS DATE) AS merge_ts, topic AS topic1, topic AS topic2, CAST(sum(d) OVER w AS BIGINT) AS document_count1, d AS document_count2, CAST(sum(c) OVER w AS BIGINT) AS count1, c AS count2, (period - DATE '2024-01-01') // {G} AS i
  FROM counts WINDOW w AS (PARTITION BY topic ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY document_count1 IS NOT NULL)"""


def merge_log(spark, sf_dir) -> DataFrame:
    """Each topic's documents of a two-day period join those before, from the topic's second period on; topics are few enough
    documents each that some periods have none."""
    day = F.col("day")
    counts = kinds(spark, sf_dir).withColumn("period", F.date_sub(day, F.pmod(F.datediff(day, F.lit("2024-01-01")), F.lit(G)))).groupBy("topic", "period").agg(F.count("*").alias("c"), F.countDistinct("document_id").alias("d"))
    before = Window.partitionBy("topic").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select(F.date_sub("period", G).alias("merge_ts"), F.col("topic").alias("topic1"), F.col("topic").alias("topic2"), F.sum("d").over(before).alias("document_count1"), F.col("d").alias("document_count2"), F.sum("c").over(before).alias("count1"), F.col("c").alias("count2"))
    return rows.filter("document_count1 is not null")


SERIES = f"""{LOG}, span AS (SELECT min(merge_ts) AS first, max(merge_ts) AS last FROM log),
placed AS (SELECT *, row_number() OVER w AS place, lead(merge_ts) OVER w AS after FROM log, span WHERE (merge_ts - first) % {G} = 0 WINDOW w AS (PARTITION BY topic1 ORDER BY merge_ts, topic2)),
idle AS (SELECT topic1, merge_ts, unnest(range(1, CAST((CASE WHEN after IS NULL THEN last + {G} ELSE after - {2 * G} END - (merge_ts + {G})) // {G} AS BIGINT) + 1)) AS n FROM placed),
steps AS (SELECT topic1 AS topic, merge_ts AS step, 0 AS kind, merge_ts AS ts, document_count1 AS amount, count1 AS par, 0 AS decay FROM placed WHERE place = 1
  UNION ALL SELECT topic1, merge_ts, 1, merge_ts + {G}, document_count2, count2, 0 FROM placed
  UNION ALL SELECT topic1, CAST(merge_ts + CAST({G} * (n + 1) AS INTEGER) AS DATE), 2, CAST(merge_ts + CAST({G} * (n + 1) AS INTEGER) AS DATE), 0, 0, 0.01 * n * n FROM idle),
summed AS (SELECT *, row_number() OVER w - 1 AS seq, sum(decay) OVER w AS dd, sum(amount) OVER w AS docs_count, sum(par) OVER w AS paragraphs_count FROM steps WINDOW w AS (PARTITION BY topic ORDER BY step, kind ROWS UNBOUNDED PRECEDING)),
series AS (SELECT b.topic, CAST(b.seq AS INTEGER) AS seq, b.ts, round(sum(a.amount * exp(CAST(a.dd - b.dd AS DOUBLE))), 9) AS popularity, CAST(any_value(b.docs_count) AS BIGINT) AS docs_count, CAST(any_value(b.paragraphs_count) AS BIGINT) AS paragraphs_count FROM summed a JOIN summed b ON a.topic = b.topic AND a.seq <= b.seq GROUP BY b.topic, b.seq, b.ts)"""


def _series(spark, sf_dir) -> DataFrame:
    """The series of the merge log; popularity to nine places, so that equal histories are ties whatever the order of their sums."""
    return S.signal_popularity(merge_log(spark, sf_dir), G).withColumn("popularity", F.round("popularity", 9))


@query(f"WITH {SERIES} SELECT topic, seq, ts, round(popularity, 6) AS popularity, docs_count, paragraphs_count FROM series")
def signal_popularity(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.withColumn("popularity", F.round("popularity", 6))


def _dates(spark, *days: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("eval_date"))


def _grid(series: DataFrame) -> DataFrame:
    return series.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(f"interval {G} days"))).alias("eval_date"))


THRESH = """th AS (SELECT eval_date, coalesce(quantile_cont(popularity, 0.1), 0) AS q1, coalesce(quantile_cont(popularity, 0.75), 0) AS q3, count(popularity) AS n_points
  FROM dates LEFT JOIN series ON ts <= eval_date AND ts >= eval_date - 7 AND popularity > 1e-5 GROUP BY eval_date)"""
ONE_DATE = "dates AS (SELECT DATE '2024-01-24' AS eval_date)"
ALL_DATES = f"dates AS (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM series), (SELECT max(ts) FROM series), INTERVAL {G} DAY)) AS DATE) AS eval_date)"
CLASSES = f"""{THRESH}, lasts AS (SELECT eval_date, topic, max(seq) AS seq FROM dates JOIN series ON ts <= eval_date + {G} AND ts >= eval_date - 7 GROUP BY ALL),
labels AS (SELECT l.eval_date, l.topic, s.popularity, s.ts AS latest_ts, s.docs_count, coalesce((SELECT regr_slope(r.popularity, CAST(r.seq AS DOUBLE)) > 0 FROM series r WHERE r.topic = s.topic AND r.ts <= s.ts AND r.ts >= s.ts - 14 AND r.ts <= l.eval_date + {G}), true) AS rising, q1, q3
  FROM lasts l JOIN series s ON s.topic = l.topic AND s.seq = l.seq JOIN th USING (eval_date)),
classes AS (SELECT *, CASE WHEN popularity < q1 THEN 'noise' WHEN popularity <= q3 THEN CASE WHEN rising THEN 'weak' ELSE 'noise' END ELSE 'strong' END AS category FROM labels)"""
CLASS_COLUMNS = "eval_date, topic, round(popularity, 6) AS popularity, latest_ts, docs_count, rising, category"


def _classes(spark, sf_dir, dates_of=None):
    series = save(_series(spark, sf_dir), "series")
    return S.classify_signals(series, _dates(spark, "2024-01-24") if dates_of is None else dates_of(series), G, 7)


def _told(df):
    return df.select("eval_date", "topic", F.round("popularity", 6).alias("popularity"), "latest_ts", "docs_count", "rising", "category")


@query(f"WITH {SERIES}, {ALL_DATES}, {THRESH} SELECT eval_date, round(q1, 6) AS q1, round(q3, 6) AS q3, n_points FROM th")
def popularity_thresholds(spark, sf_dir):
    series = save(_series(spark, sf_dir), "series")
    return S.thresholds(series, _grid(series), 7).select("eval_date", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "n_points")


@query(f"WITH {SERIES}, {ONE_DATE}, {CLASSES} SELECT {CLASS_COLUMNS} FROM classes")
def classify_signals(spark, sf_dir):
    return _told(_classes(spark, sf_dir))


@query(f"WITH {SERIES}, {ALL_DATES}, {CLASSES} SELECT {CLASS_COLUMNS} FROM classes")
def signal_evolution(spark, sf_dir):
    return _told(_classes(spark, sf_dir, _grid))


@query(f"WITH {SERIES}, {ALL_DATES} SELECT eval_date, topic, seq FROM dates JOIN series ON ts BETWEEN eval_date - 7 AND eval_date")
def evolution_points_in_window(spark, sf_dir):
    series = save(_series(spark, sf_dir), "series")
    # each point names the few grid dates it serves, so that the range join becomes an equi-join
    served = series.withColumn("eval_date", F.explode(F.sequence("ts", F.date_add("ts", 7)))).select("eval_date", "topic", "seq")
    return served.join(_grid(series), "eval_date")


@query(f"WITH {SERIES} SELECT topic, max(seq) AS seq, round(arg_max(popularity, seq), 6) AS popularity FROM series WHERE ts BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY topic")
def last_in_window(spark, sf_dir):
    series = _series(spark, sf_dir)
    return series.filter("ts between date'2024-01-10' and date'2024-01-20'").groupBy("topic").agg(F.max("seq").alias("seq"), F.round(F.max_by("popularity", "seq"), 6).alias("popularity"))


@query(f"WITH {SERIES} SELECT topic, ts, seq, popularity > 5 AS busy FROM series WHERE ts <= DATE '2024-01-15'")
def filter_series(spark, sf_dir):
    return _series(spark, sf_dir).filter("ts <= date'2024-01-15'").select("topic", "ts", "seq", (F.col("popularity") > 5).alias("busy"))


RISING = f"""WITH {SERIES} SELECT a.topic, a.seq, coalesce(regr_slope(b.popularity, CAST(b.seq AS DOUBLE)) > 0, true) AS rising FROM series a JOIN series b ON a.topic = b.topic AND b.ts BETWEEN a.ts - 14 AND a.ts GROUP BY a.topic, a.seq"""


@query(RISING)
def rising_all_dates(spark, sf_dir):
    series = _series(spark, sf_dir).withColumn("day", F.datediff("ts", F.lit("2024-01-01")))
    near = Window.partitionBy("topic").orderBy("day").rangeBetween(-14, 0)
    return series.select("topic", "seq", F.coalesce(F.regr_slope("popularity", F.col("seq").cast("double")).over(near) > 0, F.lit(True)).alias("rising"))


@query(f"WITH {SERIES}, r AS ({RISING.removeprefix(f'WITH {SERIES} ')}) SELECT topic, rising FROM r QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq DESC) = 1")
def is_rising(spark, sf_dir):
    return rising_all_dates(spark, sf_dir).groupBy("topic").agg(F.max_by("rising", "seq").alias("rising"))


@query(f"WITH {SERIES}, {ONE_DATE}, {CLASSES} SELECT category, topic, round(popularity, 6) AS popularity, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, topic) AS rank FROM classes) WHERE rank <= 3")
def top_signals(spark, sf_dir):
    return O.top_per_group(_classes(spark, sf_dir), ["category"], [F.desc("popularity"), "topic"], 3).select("category", "topic", F.round("popularity", 6).alias("popularity"), "rank")


@query(f"WITH {SERIES}, {ONE_DATE}, {CLASSES} SELECT topic, round(popularity, 6) AS popularity FROM classes ORDER BY classes.popularity DESC, topic LIMIT 5")
def top_k_by_popularity(spark, sf_dir):
    return _classes(spark, sf_dir).orderBy(F.desc("popularity"), "topic").limit(5).select("topic", F.round("popularity", 6).alias("popularity"))


TWO_DATES = "dates AS (SELECT unnest([DATE '2024-01-12', DATE '2024-01-24']) AS eval_date)"


def _two(spark, sf_dir):
    c = save(_classes(spark, sf_dir, lambda s: _dates(spark, "2024-01-12", "2024-01-24")), "classes")
    return c.filter("eval_date = date'2024-01-12'"), c.filter("eval_date = date'2024-01-24'")


STABLE = f"""{SERIES}, {TWO_DATES}, {CLASSES}, stable AS (SELECT a.topic, a.category, round(a.popularity, 6) AS pop1, round(b.popularity, 6) AS pop2, round(b.popularity - a.popularity, 6) AS change,
  round(CASE WHEN a.popularity > 0 THEN (b.popularity - a.popularity) / a.popularity * 100 ELSE 0 END, 6) AS percent FROM classes a JOIN classes b ON a.topic = b.topic AND a.category = b.category WHERE a.eval_date = DATE '2024-01-12' AND b.eval_date = DATE '2024-01-24')"""


@query(f"WITH {STABLE} SELECT * FROM stable")
def stable_topics_compare(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    change = F.col("p2") - F.col("p1")
    both = a.select("topic", "category", F.col("popularity").alias("p1")).join(b.select("topic", "category", F.col("popularity").alias("p2")), ["topic", "category"])
    return both.select("topic", "category", F.round("p1", 6).alias("pop1"), F.round("p2", 6).alias("pop2"), F.round(change, 6).alias("change"), F.round(F.when(F.col("p1") > 0, change / F.col("p1") * 100).otherwise(0.0), 6).alias("percent"))


@query(f"WITH {STABLE} SELECT topic, category, change FROM stable ORDER BY change DESC, topic LIMIT 3")
def top_changes(spark, sf_dir):
    return stable_topics_compare(spark, sf_dir).orderBy(F.desc("change"), "topic").limit(3).select("topic", "category", "change")


BUSY = f"{ACTIVITY}, t1 AS (SELECT DISTINCT topic, source FROM acts WHERE day < DATE '2024-01-02'), t2 AS (SELECT DISTINCT topic, source FROM acts WHERE day > DATE '2024-01-29')"


def _sets(spark, sf_dir):
    a = activity(spark, sf_dir)
    return a.filter("day < date'2024-01-02'").select("topic", "source").distinct(), a.filter("day > date'2024-01-29'").select("topic", "source").distinct()


@query(f"WITH {BUSY} SELECT * FROM t1 INTERSECT SELECT * FROM t2")
def topics_intersect(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query(f"WITH {SERIES}, {TWO_DATES}, {CLASSES} SELECT topic FROM classes WHERE eval_date = DATE '2024-01-24' AND category = 'strong' OR eval_date = DATE '2024-01-24' AND category = 'weak' EXCEPT SELECT topic FROM classes WHERE eval_date = DATE '2024-01-12' AND category = 'strong'")
def topics_new(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return b.filter("category in ('strong', 'weak')").select("topic").subtract(a.filter("category = 'strong'").select("topic"))


@query(f"WITH {LOG} SELECT DISTINCT topic1 AS topic FROM log WHERE merge_ts = DATE '2024-01-05' AND topic1 NOT IN (SELECT topic1 FROM log WHERE merge_ts = DATE '2024-01-07')")
def topics_gone(spark, sf_dir):
    log = merge_log(spark, sf_dir)
    return log.filter("merge_ts = date'2024-01-05'").select(F.col("topic1").alias("topic")).distinct().join(log.filter("merge_ts = date'2024-01-07'").select(F.col("topic1").alias("topic")), "topic", "left_anti")


@query(f"WITH {LOG}, a AS (SELECT DISTINCT topic1 AS topic FROM log WHERE merge_ts <= DATE '2024-01-05'), b AS (SELECT DISTINCT topic1 AS topic FROM log WHERE merge_ts BETWEEN DATE '2024-01-07' AND DATE '2024-01-09'), c AS (SELECT topic, 'stable' AS change FROM a INTERSECT SELECT topic, 'stable' FROM b) SELECT * FROM c UNION ALL SELECT topic, 'new' FROM (SELECT topic FROM b EXCEPT SELECT topic FROM a) UNION ALL SELECT topic, 'gone' FROM (SELECT topic FROM a EXCEPT SELECT topic FROM b)")
def topic_sets_diff(spark, sf_dir):
    log = merge_log(spark, sf_dir)
    a = log.filter("merge_ts <= date'2024-01-05'").select(F.col("topic1").alias("topic")).distinct().withColumn("a", F.lit(True))
    b = log.filter("merge_ts between date'2024-01-07' and date'2024-01-09'").select(F.col("topic1").alias("topic")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "topic", "full").select("topic", F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").otherwise("stable").alias("change"))


@query(f"WITH {LOG} SELECT DISTINCT a.topic1 AS topic, s.merge_ts FROM log a, (SELECT DISTINCT merge_ts FROM log) s WHERE NOT EXISTS (SELECT 1 FROM log b WHERE b.topic1 = a.topic1 AND b.merge_ts IN (s.merge_ts, s.merge_ts + {G}))")
def idle_topics(spark, sf_dir):
    log = merge_log(spark, sf_dir).select(F.col("topic1").alias("topic"), "merge_ts")
    grid = log.select("topic").distinct().crossJoin(F.broadcast(log.select("merge_ts").distinct()))
    busy = log.select("topic", F.explode(F.array("merge_ts", F.date_sub("merge_ts", G))).alias("merge_ts")).distinct()
    return grid.join(busy, ["topic", "merge_ts"], "left_anti")


LINKS = f"""{LOG}, stamps AS (SELECT merge_ts, row_number() OVER (ORDER BY merge_ts) - 1 AS idx, coalesce(lead(merge_ts) OVER (ORDER BY merge_ts), merge_ts) AS next_ts FROM (SELECT DISTINCT merge_ts FROM log)),
r AS (SELECT l.*, idx, next_ts, lead(idx) OVER (PARTITION BY topic1 ORDER BY idx) AS next_idx FROM log l JOIN stamps USING (merge_ts)),
links AS (SELECT merge_ts AS ts, idx || '_1_' || topic1 AS source, coalesce(next_idx || '_1_' || topic1, idx || '_1_' || topic1 || '_new') AS destination, document_count1 AS count FROM r
  UNION ALL SELECT next_ts, idx || '_2_' || topic2, coalesce(next_idx || '_1_' || topic1, idx || '_1_' || topic1 || '_new'), document_count1 + document_count2 FROM r)"""


@query(f"WITH {LINKS} SELECT ts, source, destination, min(count) AS count FROM links GROUP BY ALL")
def sankey_links(spark, sf_dir):
    return S.sankey_links(merge_log(spark, sf_dir))


@query(f"WITH {LINKS} SELECT ts, source, destination, min(count) AS count FROM links WHERE regexp_matches(source, '_[12]_3[0-9]{{3}}$') GROUP BY ALL")
def sankey_connected(spark, sf_dir):
    """The flow into the last merges of the topics of one user."""
    links = save(S.sankey_links(merge_log(spark, sf_dir)), "links")
    return S.connected(links, links.filter(F.col("destination").rlike("_3[0-9]{3}_new$")).select(F.col("destination").alias("node")), save)


@query(f"WITH {LOG}, p AS (SELECT merge_ts, dense_rank() OVER (ORDER BY merge_ts DESC) AS r FROM (SELECT DISTINCT merge_ts FROM log WHERE merge_ts <= DATE '2024-01-15')) SELECT topic1, merge_ts, document_count2 FROM log JOIN p USING (merge_ts) WHERE r <= 3")
def recent_merge_context(spark, sf_dir):
    log = merge_log(spark, sf_dir).filter("merge_ts <= date'2024-01-15'")
    last = log.select("merge_ts").distinct().orderBy(F.desc("merge_ts")).limit(3)
    return log.join(F.broadcast(last), "merge_ts", "left_semi").select("topic1", "merge_ts", "document_count2")


@query(f"WITH {LOG}, d AS (SELECT DISTINCT topic1, i FROM log) SELECT topic1, i, lead(i) OVER (PARTITION BY topic1 ORDER BY i) AS next_i FROM d")
def next_merge_index(spark, sf_dir):
    log = merge_log(spark, sf_dir).select("topic1", F.floor(F.datediff("merge_ts", F.lit("2024-01-01")) / G + 1).alias("i")).distinct()
    return log.withColumn("next_i", F.lead("i").over(Window.partitionBy("topic1").orderBy("i")))


@query(f"WITH {LOG} SELECT topic1, merge_ts, CAST(sum(document_count2) OVER w AS BIGINT) AS documents, CAST(sum(count2) OVER w AS BIGINT) AS paragraphs FROM log WINDOW w AS (PARTITION BY topic1 ORDER BY merge_ts, topic2 ROWS UNBOUNDED PRECEDING)")
def running_counts(spark, sf_dir):
    w = Window.partitionBy("topic1").orderBy("merge_ts", "topic2").rowsBetween(Window.unboundedPreceding, 0)
    return merge_log(spark, sf_dir).select("topic1", "merge_ts", F.sum("document_count2").over(w).alias("documents"), F.sum("count2").over(w).alias("paragraphs"))


@query(f"WITH {LOG} SELECT merge_ts, topic1, topic2, CAST(document_count1 + document_count2 AS BIGINT) AS merged FROM log")
def running_merged_count(spark, sf_dir):
    w = Window.partitionBy("merge_ts", "topic1").orderBy("topic2")
    return merge_log(spark, sf_dir).select("merge_ts", "topic1", "topic2", (F.first("document_count1").over(w) + F.sum("document_count2").over(w)).alias("merged"))


DIVERSITY = f"WITH {DOCS}, r AS (SELECT lang AS topic, source, CAST(ts AS DATE) AS ts FROM docs) SELECT DISTINCT a.topic, a.ts, (SELECT count(DISTINCT source) FROM r b WHERE b.topic = a.topic AND b.ts <= a.ts) AS diversity FROM r a"


@query(DIVERSITY)
def source_diversity(spark, sf_dir):
    return S.source_diversity(documents(spark, sf_dir).select(F.col("lang").alias("topic"), "source", F.to_date("ts").alias("ts")))


@query(f"WITH {ACTIVITY} SELECT DISTINCT a.topic, a.day AS ts, (SELECT count(DISTINCT source) FROM acts b WHERE b.topic = a.topic AND b.day <= a.day) AS diversity FROM acts a")
def running_distinct_sources(spark, sf_dir):
    return S.source_diversity(activity(spark, sf_dir).select("topic", "source", F.col("day").alias("ts")))


@query(f"""WITH {LOG}, z AS (SELECT CASE WHEN topic1 % 2 = 0 THEN 'even' ELSE 'odd' END || CAST(topic1 % 3 AS VARCHAR) AS name, CAST(merge_ts + {G} AS DATE) AS ts, sum(document_count2) AS c FROM log GROUP BY ALL),
grid AS (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM z), (SELECT max(ts) FROM z), INTERVAL {G} DAY)) AS DATE) AS ts), names AS (SELECT DISTINCT name FROM z UNION ALL SELECT 'never'),
r AS (SELECT n.name, g.ts, z.c, row_number() OVER (PARTITION BY n.name ORDER BY g.ts) AS k FROM names n CROSS JOIN grid g LEFT JOIN z ON z.name = n.name AND z.ts = g.ts),
i AS (SELECT *, k - coalesce(max(CASE WHEN c IS NOT NULL THEN k END) OVER (PARTITION BY name ORDER BY ts), 0) AS idle FROM r), d AS (SELECT *, sum(CASE WHEN c IS NULL THEN 0.01 * idle * idle ELSE 0 END) OVER (PARTITION BY name ORDER BY ts) AS dd FROM i)
SELECT b.name, b.ts, round(sum(coalesce(a.c, 0) * exp(CAST(a.dd - b.dd AS DOUBLE))), 6) AS popularity FROM d a JOIN d b ON a.name = b.name AND a.ts <= b.ts GROUP BY b.name, b.ts""")
def zeroshot_trend(spark, sf_dir):
    log = merge_log(spark, sf_dir)
    name = F.concat(F.when(F.col("topic1") % 2 == 0, "even").otherwise("odd"), (F.col("topic1") % 3).cast("string"))
    info = log.groupBy(name.alias("name"), F.date_add("merge_ts", G).alias("ts")).agg(F.sum("document_count2").alias("document_count"))
    names = info.select("name").distinct().union(spark.range(1).select(F.lit("never").alias("name")))
    return S.zeroshot_trend(info, names, G).withColumn("popularity", F.round("popularity", 6))


def _signals_path(spark, sf_dir):
    path = scratch(spark, "signals")
    rows = _classes(spark, sf_dir, lambda s: _dates(spark, "2024-01-12", "2024-01-18", "2024-01-24")).select(F.col("eval_date").cast("string").alias("reference_ts"), "category", "topic", F.round("popularity", 6).alias("popularity"))
    from tidemark.sources import files

    files.write_signals(rows, path)
    return path


THREE = "dates AS (SELECT unnest([DATE '2024-01-12', DATE '2024-01-18', DATE '2024-01-24']) AS eval_date)"
STORED = f"WITH {SERIES}, {THREE}, {CLASSES}"


@query(f"{STORED} SELECT CAST(eval_date AS VARCHAR) AS reference_ts, category, topic, round(popularity, 6) AS popularity FROM classes")
def write_signals(spark, sf_dir):
    return spark.read.parquet(_signals_path(spark, sf_dir)).select(F.col("reference_ts").cast("string").alias("reference_ts"), "category", "topic", "popularity")


@query(f"{STORED} SELECT CAST(eval_date AS VARCHAR) AS reference_ts, category, topic, round(popularity, 6) AS popularity FROM classes WHERE eval_date BETWEEN DATE '2024-01-13' AND DATE '2024-01-24'")
def read_signals_between(spark, sf_dir):
    from tidemark.sources import files

    return files.read_signals_between(spark, _signals_path(spark, sf_dir), "2024-01-13", "2024-01-24").select(F.col("reference_ts").cast("string").alias("reference_ts"), "category", "topic", "popularity")


@query(f"{STORED} SELECT DISTINCT CAST(eval_date AS VARCHAR) AS reference_ts FROM classes")
def list_periods(spark, sf_dir):
    from tidemark.sources import files

    return files.list_periods(spark, _signals_path(spark, sf_dir)).select(F.col("reference_ts").cast("string").alias("reference_ts"))


@query(f"{STORED} SELECT topic, round(avg(popularity), 6) AS popularity FROM classes GROUP BY topic ORDER BY round(avg(classes.popularity), 9) DESC, topic LIMIT 10")
def avg_popularity_topk(spark, sf_dir):
    c = _classes(spark, sf_dir, lambda s: _dates(spark, "2024-01-12", "2024-01-18", "2024-01-24"))
    return c.groupBy("topic").agg(F.round(F.avg("popularity"), 9).alias("p")).orderBy(F.desc("p"), "topic").limit(10).select("topic", F.round("p", 6).alias("popularity"))


SIGNAL_URLS = "u AS (SELECT topic, list_sort(list(DISTINCT concat('https://', source, '.example.com/', json_extract_string(props, '$.k')))) AS s FROM kinds JOIN events ON event_id = document_id GROUP BY topic)"


def signal_urls(spark, sf_dir) -> DataFrame:
    """topic, s: the distinct addresses of a topic's documents (about ten; a topic is one user's acts of one kind)."""
    props = table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.get_json_object("props", "$.k").alias("k"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "k")
    return kinds(spark, sf_dir).join(props, "document_id").groupBy("topic").agg(F.sort_array(F.collect_set(url)).alias("s"))


@query(f"WITH {SERIES}, {ONE_DATE}, {CLASSES}, {SIGNAL_URLS} SELECT topic, category, array_to_string(s, ' ') AS urls FROM classes LEFT JOIN u USING (topic)")
def signals_with_urls(spark, sf_dir):
    return _classes(spark, sf_dir).join(signal_urls(spark, sf_dir), "topic", "left").select("topic", "category", F.array_join("s", " ").alias("urls"))


@query(f"WITH {SERIES}, {ONE_DATE}, {CLASSES}, j AS (SELECT topic, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k FROM kinds JOIN events ON event_id = document_id GROUP BY topic) SELECT topic, category, k FROM classes LEFT JOIN j USING (topic)")
def signals_with_interpretation(spark, sf_dir):
    props = table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), "props")
    told = kinds(spark, sf_dir).join(props, "document_id").groupBy("topic").agg(F.max(F.from_json("props", "k bigint")["k"]).alias("k"))
    return _classes(spark, sf_dir).join(told, "topic", "left").select("topic", "category", "k")


@query()
def incremental_update(spark, sf_dir):
    """A job takes in all periods but the newest, and in a later run the newest alone; the registry and how its signals are labelled."""
    topics, home = save(O.period_topics(vectors(spark, sf_dir)), "topics"), scratch(spark, "job")
    newest = topics.agg(F.max("period").alias("p")).first()["p"]
    jobs.advance(spark, topics.filter(F.col("period") < F.lit(newest)), home, SIMILARITY, DAYS, 2 * DAYS)
    jobs.advance(spark, topics, home, SIMILARITY, DAYS, 2 * DAYS)
    registry = jobs.result(spark, home, "registry").select("topic", "birth", "count", "document_count", F.size("sources").alias("n_sources"))
    labels = jobs.result(spark, home, "signals").filter(F.col("period") == F.lit(str(newest))).select("topic", "category", F.round("popularity", 6).alias("popularity"))
    return registry.join(labels, "topic", "left")


@query()
def regenerate_history(spark, sf_dir):
    """From vectors to labels in one chain: topics, merges, series, labels at each grid date."""
    _, log = merging.merge_all_periods(O.period_topics(vectors(spark, sf_dir)), SIMILARITY, save)
    series = save(S.signal_popularity(log, DAYS), "series")
    grid = series.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence("a", "b", F.expr(f"interval {DAYS} days"))).alias("eval_date"))
    return _told(S.classify_signals(series, grid, DAYS, 14))


@query(f"WITH {VECTORS} SELECT period, count(DISTINCT topic) FILTER (topic != -1) AS topics, count(*) FILTER (topic = -1) AS outliers FROM vecs GROUP BY period")
def topics_per_period(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("period").agg(F.countDistinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("topics"), F.count_if(F.col("topic") == -1).alias("outliers"))


@query(f"WITH {VECTORS} SELECT period, CAST(count(*) FILTER (topic = -1) AS BIGINT) AS outliers FROM vecs GROUP BY period")
def outlier_size(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("period").agg(F.count_if(F.col("topic") == -1).alias("outliers"))


COUNT_DUMP = f"WITH {VECTORS}, n AS (SELECT period, CAST(max(topic) + 1 AS BIGINT) AS topics FROM vecs GROUP BY period), b AS (SELECT topic, min(period) AS period FROM vecs WHERE topic != -1 GROUP BY topic) SELECT period, topics, (SELECT count(*) FROM b WHERE b.period <= n.period) AS registry FROM n"


@query(COUNT_DUMP)
def topic_count_dump(spark, sf_dir):
    v = vectors(spark, sf_dir)
    born = v.filter("topic != -1").groupBy("topic").agg(F.min("period").alias("period")).groupBy("period").agg(F.count("*").alias("new"))
    n = v.groupBy("period").agg((F.max("topic") + 1).cast("long").alias("topics")).join(born, "period", "left")
    return n.select("period", "topics", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("period")).alias("registry"))


@query(COUNT_DUMP.replace("period, topics, (", "period, ("))
def cumulative_topic_count(spark, sf_dir):
    return topic_count_dump(spark, sf_dir).drop("topics")
