"""Queries on sources, cleaning, filters, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, text as T
from tidemark.operators import cleaning as C
from tidemark.operators.written import scratch
from tidemark.plans.bindings import DOCS, documents, query, table
from tidemark.sources import files


@query(f"WITH {DOCS} SELECT document_id, title, source, count(*) OVER (PARTITION BY document_id) AS formats FROM docs, (SELECT unnest([1, 2, 3]) AS f)")
def read_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select("document_id", "title", "source")
    parts = []
    for kind in ("csv", "jsonl", "parquet"):
        path = scratch(spark, f"feed.{kind}")
        writer = docs.write
        writer.csv(path, header=True, escape='"', quoteAll=True) if kind == "csv" else writer.json(path) if kind == "jsonl" else writer.parquet(path)
        parts.append(files.read_documents(spark, path, "document_id long, title string, source string").fillna({"title": ""}))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.join(both.groupBy("document_id").agg(F.count("*").alias("formats")), "document_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def discover_files(spark, sf_dir):
    path = scratch(spark, "feeds")
    documents(spark, sf_dir).select("document_id", "source").repartition("source").write.partitionBy("source").json(path)
    found = files.discover_files(spark, path, "*.json").select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).distinct()
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path).groupBy(F.regexp_extract("_metadata.file_path", "source=([^/]+)/", 1).alias("source")).agg(F.count("*").alias("n"))
    return rows.join(found, "source", "left_semi")


@query(f"WITH {DOCS} SELECT document_id, text, ts AS timestamp FROM docs")
def validate_schema(spark, sf_dir):
    return files.validate_schema(documents(spark, sf_dir).select("document_id", F.col("text").alias("content"), F.col("ts").alias("date")), {"text": ["content", "body"], "timestamp": ["date"]})


@query(f"""WITH {DOCS}, feeds AS (SELECT *, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS feed FROM docs)
SELECT title, document_id, feed FROM feeds QUALIFY row_number() OVER (PARTITION BY title ORDER BY feed, document_id) = 1""")
def union_feeds(spark, sf_dir):
    d = documents(spark, sf_dir).select("title", "document_id", (F.col("lang") == "en").alias("english"))
    parts = [d.filter(f"coalesce(english, false) = {bool(i)}").drop("english").withColumn("feed", F.lit(i)) for i in (0, 1)]
    return files.union_feeds(parts, "title", ["feed", "document_id"])


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def latest_feed_file(spark, sf_dir):
    """Every language is a delivery of the feed, in a folder of its own with any number of files; the French one comes last."""
    import time

    path, d = scratch(spark, "feed"), table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    for last in (False, True):
        time.sleep(1.1 * last)
        d.filter((F.col("lang") == "fr") == last).repartition("lang").write.mode("append").partitionBy("lang").json(path)
    rows = spark.read.schema("doc_id long, source string").option("recursiveFileLookup", "true").json(path)
    return files.latest_feed_file(rows, r"/lang=[^/]*/")


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def append_jsonl(spark, sf_dir):
    path, d = scratch(spark, "articles"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    files.append_jsonl(d, path)
    files.append_jsonl(d.filter("lang = 'de'"), path)
    return spark.read.schema("doc_id long, lang string").json(path)


CLEAN = f"""WITH {DOCS}, once AS (SELECT * FROM docs WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts, text ORDER BY document_id) = 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY ts, document_id) - 1 AS number FROM once)"""


@query(f"""{CLEAN} SELECT number, document_id, ts, title, split_part(url, '/', 3) AS source FROM numbered
QUALIFY row_number() OVER (PARTITION BY title ORDER BY number) = 1""")
def clean_documents(spark, sf_dir):
    return C.clean_documents(documents(spark, sf_dir), keep_text=False).select("number", "document_id", "ts", "title", "source")


@query(f"{CLEAN} SELECT number, document_id FROM numbered")
def number_documents(spark, sf_dir):
    return C.number_in_order(C.first_per_key(documents(spark, sf_dir), ["ts", F.sha2("text", 256)], ["document_id"]).select("ts", "document_id"), ["ts", "document_id"]).select("number", "document_id")


@query(f"WITH {DOCS} SELECT title, min(document_id) AS document_id FROM docs GROUP BY title")
def first_per_key(spark, sf_dir):
    return C.first_per_key(documents(spark, sf_dir), ["title"], ["document_id"]).select("title", "document_id")


@query("SELECT page_id, split_part(url, '/', 3) AS source FROM pages")
def source_from_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.source_from_url(F.col("url")).alias("source"))


HOST = "regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)"


@query(f"SELECT page_id, coalesce(nullif(split_part(replace({HOST}, 'www.', ''), '.', 1), ''), 'Unknown') AS website FROM pages")
def website_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.website_name(F.col("url")).alias("website"))


@query(f"SELECT page_id, regexp_extract(lower({HOST}), '([^.]+)\\.(?:{'|'.join(T.SUFFIXES).replace('.', chr(92) + '.')})$', 1) AS domain FROM pages")
def registered_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.registered_domain(F.col("url")).alias("domain"))


@query(f"""WITH t1 AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '’', ''''), '([\\p{{L}}\\p{{N}}_])[-/;:]', '\\1 ', 'g'), '[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\t-\\r.,''"()\\[\\]]', ' ', 'g') AS t FROM documents),
t2 AS (SELECT doc_id, translate(translate(t, '{T.RAISED}', '{T.RAISED_PLAIN}'), '{T.LOWERED}', '{T.LOWERED_PLAIN}') AS t FROM t1)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[ \\t]+', ' ', 'g')) AS digest FROM t2""")
def normalize_french_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise_french(F.col("text"))).alias("digest"))


@query(f"""WITH t1 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(replace(text, '’', '''')), '[-/;:]', ' ', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])[ld]''', '\\1', 'g'), '[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\t-\\r]', ' ', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(translate(translate(t, '{T.RAISED}', '{T.RAISED_PLAIN}'), '{T.LOWERED}', '{T.LOWERED_PLAIN}'), '[\\p{{Z}}\\t-\\r]+', ' ', 'g'))) AS digest FROM t1""")
def aggressive_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.aggressive_normalise(F.col("text"))).alias("digest"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 500")
def min_length_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 500).select("doc_id", "n_chars")


PARAGRAPHS = """parts AS (SELECT doc_id, CASE WHEN len(string_split(text, chr(10) || chr(10))) = 1 THEN string_split(text, chr(10)) ELSE string_split(text, chr(10) || chr(10)) END AS p FROM documents),
paragraphs AS (SELECT doc_id AS document_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE length(p[i]) >= 50 AND regexp_matches(p[i], '\\S'))"""


@query(f"WITH {PARAGRAPHS} SELECT document_id, pos, text FROM paragraphs")
def split_paragraphs(spark, sf_dir):
    return C.split_paragraphs(documents(spark, sf_dir).select("document_id", "text"), 50)


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query(rf"""WITH RECURSIVE {DOCS}, pa AS (SELECT document_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS par, trim(unnest(p), {_BLANKS}) AS t FROM (SELECT document_id, string_split_regex(text, '\n+') AS p FROM docs)),
se AS (SELECT document_id, par, CAST(generate_subscripts(s, 1) AS INTEGER) AS i, unnest(s) AS t FROM (SELECT document_id, par, string_split(regexp_replace(t, '([.!?])[\t-\r ]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM pa)),
n AS (SELECT *, len(regexp_extract_all(t, '[^\t-\r ]+')) AS n FROM se),
walk(document_id, par, step, i, t, n, held, used, one, two) AS (SELECT document_id, par, 0, i, t, n, CAST('' AS VARCHAR), CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST('' AS VARCHAR) FROM n WHERE i = 1
  UNION ALL (WITH cut AS (SELECT w.*, w.n > 60 AS big, w.held <> '' AND w.used + w.n > 60 AS more, greatest(1, length(w.t) * 60 // greatest(w.n, 1)) AS upto FROM walk w WHERE w.t IS NOT NULL),
    done AS (SELECT c.*, CASE WHEN big THEN trim(substr(t, upto + 1), {_BLANKS}) END AS rest FROM cut c)
    SELECT d.document_id, d.par, d.step + 1, CASE WHEN big THEN d.i ELSE d.i + 1 END, CASE WHEN big THEN rest ELSE x.t END, CASE WHEN big THEN len(regexp_extract_all(rest, '[^\t-\r ]+')) ELSE x.n END,
      CASE WHEN big THEN '' WHEN d.t = '' THEN CASE WHEN more THEN '' ELSE held END WHEN more OR held = '' THEN d.t ELSE held || ' ' || d.t END, CASE WHEN big THEN 0 WHEN more THEN d.n ELSE used + d.n END,
      CASE WHEN big OR more THEN held ELSE '' END, CASE WHEN big THEN trim(substr(d.t, 1, upto), {_BLANKS}) ELSE '' END
    FROM done d LEFT JOIN n x ON NOT big AND x.document_id = d.document_id AND x.par = d.par AND x.i = d.i + 1)),
pieces AS (SELECT document_id, par, step, 0 AS k, one AS piece FROM walk UNION ALL SELECT document_id, par, step, 1, two FROM walk UNION ALL SELECT document_id, par, step, 2, held FROM walk WHERE t IS NULL)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY par, step, k) - 1 AS INTEGER) AS pos, piece AS text FROM pieces WHERE piece <> ''""")
def split_sentences_budget(spark, sf_dir):
    return C.split_sentences_budget(documents(spark, sf_dir).select("document_id", "text"), 60)


@query(f"WITH {DOCS} SELECT document_id, ts FROM docs WHERE ts >= (SELECT max(ts) FROM docs) - INTERVAL 7 DAY")
def cutoff_recent(spark, sf_dir):
    return C.cutoff_recent(documents(spark, sf_dir).select("document_id", "ts"), 7)


@query(f"WITH {DOCS} SELECT document_id, ts FROM docs WHERE ts >= TIMESTAMP '2024-01-10'")
def since_filter(spark, sf_dir):
    return documents(spark, sf_dir).filter("ts >= timestamp_ntz'2024-01-10 00:00:00'").select("document_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def date_range_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).filter("ts between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-12 00:00:00'")


@query("SELECT DISTINCT text, lang, source FROM documents")
def dedupe_all(spark, sf_dir):
    """Rows that are equal in every column, told by the text's digest."""
    d = table(spark, sf_dir, "documents").select("text", "lang", "source", F.sha2("text", 256).alias("digest"))
    return d.dropDuplicates(["digest", "lang", "source"]).drop("digest")


@query(f"WITH {DOCS} SELECT md5(text) AS digest, title, min(document_id) AS document_id FROM docs GROUP BY text, title")
def dedupe_text_title(spark, sf_dir):
    """The first document of each text and title; texts are compared by a digest and don't travel."""
    d = documents(spark, sf_dir).select(F.sha2("text", 256).alias("key"), F.md5("text").alias("digest"), "title", "document_id")
    return d.groupBy("key", "digest", "title").agg(F.min("document_id").alias("document_id")).drop("key")


@query(f"""WITH {DOCS}, r AS (SELECT concat('https://', source, '/', document_id % 50) AS url, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS priority, document_id, text FROM docs)
SELECT url, priority, document_id, left(text, 200) AS summary FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority, document_id) = 1""")
def dedupe_url_priority(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), "source", F.lit("/"), (F.col("document_id") % 50).cast("string")))
    return C.dedupe_url_priority(d, F.when(F.col("lang") == "en", 0).otherwise(1), "document_id").select("url", "priority", "document_id", "summary")


@query(f"WITH {DOCS} SELECT document_id, url FROM docs WHERE NOT contains(url, 'src3.example.com') AND NOT contains(url, 'src7.example.com')")
def blacklist_filter(spark, sf_dir):
    return C.blacklist_filter(documents(spark, sf_dir)).select("document_id", "url")


@query("SELECT page_id FROM pages WHERE NOT (contains(lower(html), '[if') OR contains(lower(html), 'javascript') OR contains(lower(html), 'cookie') OR contains(lower(html), 'subscribe to read'))")
def bad_text_filter(spark, sf_dir):
    return C.bad_text_filter(table(spark, sf_dir, "pages").withColumnRenamed("html", "text")).select("page_id")


_STOP = ", ".join(f"('{lang}', '{w}')" for lang, own in C.STOP_WORDS.items() for w in own)


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}')) AS word FROM documents),
v AS (SELECT doc_id, language, count(*) AS votes FROM t JOIN (VALUES {_STOP}) AS s(language, w) ON word = w GROUP BY doc_id, language),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, language) = 1)
SELECT b.doc_id, lang, votes FROM b JOIN documents d ON b.doc_id = d.doc_id WHERE language = 'fr'""")
def language_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = C.language_votes(d, "doc_id").filter("detected = 'fr'")
    return d.join(found, "doc_id").select("doc_id", "lang", "votes")


@query("""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\\s]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, sf_dir):
    return C.html_to_text(table(spark, sf_dir, "pages")).select("page_id", "title", "text")


@query("SELECT page_id, url AS target FROM pages")
def clean_redirect_url(spark, sf_dir):
    wrapped = F.concat(F.lit("https://search.example.com/click?id=1&url="), F.url_encode("url"), F.lit("&x=2"))
    return table(spark, sf_dir, "pages").select("page_id", T.clean_redirect_url(wrapped).alias("target"))


@query("SELECT doc_id, lang FROM documents WHERE CAST(concat('0x', left(md5(CAST(doc_id AS VARCHAR)), 8)) AS BIGINT) % 100 < 20")
def sample_documents(spark, sf_dir):
    return C.sample_by_hash(table(spark, sf_dir, "documents"), "doc_id", 20).select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src19')")
def keyword_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("source"), F.lit("src19"))).select("doc_id", "source")


@query(f"WITH {DOCS} SELECT document_id, source FROM docs WHERE source IN ('src1', 'src5', 'src9')")
def select_sources(spark, sf_dir):
    return documents(spark, sf_dir).filter(T.website_name(F.col("url")).isin("src1", "src5", "src9")).select("document_id", "source")


def _texts_of_dates(spark, sf_dir):
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy"]
    d = documents(spark, sf_dir).select("document_id", "ts")
    told = F.when(F.col("document_id") % 4 == 0, F.date_format("ts", formats[0])).when(F.col("document_id") % 4 == 1, F.date_format("ts", formats[1])).when(F.col("document_id") % 4 == 2, F.date_format("ts", formats[2])).otherwise("soon")
    return d.withColumn("told", told)


@query(f"""WITH {DOCS} SELECT document_id, CASE WHEN document_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN document_id % 4 < 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM docs""")
def parse_dates(spark, sf_dir):
    return _texts_of_dates(spark, sf_dir).select("document_id", T.parse_date(F.col("told")).alias("parsed"))


@query("""WITH s AS (SELECT event_id, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01')) AS BIGINT) AS s FROM events),
p AS (SELECT event_id, s, list_filter([CASE WHEN s // 86400 > 0 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || ' hour' || CASE WHEN s % 86400 // 3600 > 1 THEN 's' ELSE '' END END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || ' minute' || CASE WHEN s % 3600 // 60 > 1 THEN 's' ELSE '' END END, CASE WHEN s % 60 > 0 THEN (s % 60) || ' second' || CASE WHEN s % 60 > 1 THEN 's' ELSE '' END END], lambda x: x IS NOT NULL) AS parts FROM s)
SELECT event_id, CASE WHEN len(parts) = 0 THEN '0 seconds' ELSE array_to_string(parts, ', ') END AS told FROM p""")
def format_duration(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", T.duration(F.floor((dates.micros(ts) - dates.micros(F.expr("timestamp_ntz'2024-01-01 00:00:00'"))) / 1_000_000)).alias("told"))


@query("""WITH u AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY user_id),
g AS (SELECT user_id, b, unnest(generate_series(a, CASE WHEN a + INTERVAL 5 DAY > b THEN a ELSE b - INTERVAL 1 DAY END, INTERVAL 5 DAY)) AS s FROM u)
SELECT user_id, CAST(s AS DATE) AS range_start, CAST(least(s + INTERVAL 5 DAY, CAST(b AS TIMESTAMP)) AS DATE) AS range_end FROM g""")
def date_ranges(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return dates.date_ranges(spark, F.col("a"), F.col("b"), 5, u).select("user_id", "range_start", "range_end")


@query("""WITH k AS (SELECT DISTINCT event_type AS keyword FROM events), d AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events),
g AS (SELECT b, unnest(generate_series(a, b - INTERVAL 1 DAY, INTERVAL 7 DAY)) AS s FROM d)
SELECT keyword, CAST(s AS DATE) AS range_start, CAST(least(s + INTERVAL 7 DAY, CAST(b AS TIMESTAMP)) AS DATE) AS range_end FROM k, g""")
def query_grid(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    span = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    ranges = dates.date_ranges(spark, F.col("a"), F.col("b"), 7, span).select("range_start", "range_end")
    return e.select(F.col("event_type").alias("keyword")).distinct().crossJoin(F.broadcast(ranges))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_analysis_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id AS id, lang FROM documents UNION SELECT page_id AS id, split_part(url, '/', 4) AS lang FROM pages")
def union_periods(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return d.unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.get(F.split("url", "/"), F.lit(3)).alias("lang"))).distinct()
