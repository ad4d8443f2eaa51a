"""Scans, filters, projections, limits and writes."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text, urls
from feedloom.functions.text import contains
from feedloom.operators.ranking import in_window
from feedloom.plans.registry import query
from feedloom.sources import upserts
from feedloom.sources.items import AS_OF, DAY, items, read, with_urls
from feedloom.sources.places import new_place
from feedloom.sources.versions import SnapshotTable

HOST = "example.net"  # plays the aggregator


@query("SELECT page_id, url FROM pages")
def scan_table(spark, d):
    return read(spark, d, "pages").select("page_id", "url")


@query("SELECT id, source_title, published_at FROM items WHERE category = 'ai_news' AND published_at >= 1767225600 - 7 * 86400", "items")
def filter_category_window(spark, d):
    rows = items(spark, d).where((F.col("category") == "ai_news") & in_window("published_at", AS_OF, 7))
    return rows.select("id", "source_title", "published_at").orderBy(F.desc("published_at"), "id")


@query("SELECT id FROM items WHERE (1767225600 - published_at) / 86400.0 <= 30", "items")
def filter_window_recheck(spark, d):
    return items(spark, d).where((F.lit(AS_OF) - F.col("published_at")) / DAY <= 30).select("id")


@query("""SELECT id, CASE WHEN contains(url, 'example.net') THEN CASE WHEN id % 2 = 0 THEN 'https://target.example/' || id ELSE url END ELSE url END AS final_url FROM urls""", "urls")
def project_final_url(spark, d):
    rows = with_urls(items(spark, d).select("id"), spark, d)
    target = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://target.example/"), F.col("id").cast("string"))).otherwise("")
    return rows.select("id", urls.final_url("url", target, [HOST]).alias("final_url"))


@query("SELECT id, title FROM items WHERE id = 42", "items")
def lookup_by_key(spark, d):
    return items(spark, d).where("id = 42").select("id", "title")


@query("SELECT id, category FROM items WHERE id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)", "items")
def filter_in_list(spark, d):
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)], "id long")
    return items(spark, d).join(F.broadcast(wanted), "id", "left_semi").select("id", "category")


@query("""SELECT id, source_title FROM items WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%then%'
  OR translate(source_title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%then%' ORDER BY published_at DESC, id LIMIT 50""", "items")
def filter_like_any(spark, d):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"  # only ASCII letters fold
    hit = F.translate("title", upper, lower).like("%then%") | F.translate("source_title", upper, lower).like("%then%")
    return items(spark, d).where(hit).orderBy(F.desc("published_at"), "id").limit(50).select("id", "source_title")


@query("SELECT i.id FROM items i WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.id) ORDER BY published_at, id LIMIT 25", "items")
def filter_is_null(spark, d):
    rated = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return items(spark, d).join(rated, "id", "left").where(F.col("quality").isNull()).orderBy("published_at", "id").limit(25).select("id")


@query("SELECT id FROM items WHERE length(summary) <= 3000", "items")
def filter_oversized(spark, d):
    text = F.coalesce(F.nullif("summary", F.lit("")), F.lit(""))
    return items(spark, d).where(F.length(text) <= 3000).select("id")


@query("SELECT page_id FROM pages WHERE (url LIKE 'http://%' OR url LIKE 'https://%') AND url NOT LIKE '%example.net%'")
def filter_valid_url(spark, d):
    return read(spark, d, "pages").where(urls.valid_url("url", [HOST])).select("page_id")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, 'reddit\\.com/(r|u|user)/|news\\.google\\.com/rss/articles/', 'i')")
def filter_excluded_item(spark, d):
    return read(spark, d, "pages").where(~urls.excluded_item("url")).select("page_id")


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE CASE WHEN l.doc_id IS NULL THEN 5 ELSE l.quality * 5 + 1 END >= 3")
def filter_min_relevance(spark, d):
    score = read(spark, d, "labels").select("doc_id", (F.col("quality") * 5 + 1).alias("s"))
    return read(spark, d, "documents").join(score, "doc_id", "left").where(F.coalesce("s", F.lit(5)) >= 3).select(F.col("doc_id").alias("id"))


@query("SELECT doc_id AS id FROM documents WHERE text IS NULL OR length(text) < 100")
def filter_fulltext_missing(spark, d):
    return read(spark, d, "documents").where(F.col("text").isNull() | (F.length("text") < 100)).select(F.col("doc_id").alias("id"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) NOT LIKE '%steel%' AND lower(p_name) NOT LIKE '%red%'")
def blocklist_library(spark, d):
    name = F.lower("p_name")
    return read(spark, d, "part").where(~contains(name, "steel") & ~contains(name, "red")).select("p_partkey")


@query("SELECT id, title FROM items ORDER BY published_at DESC, id OFFSET 20 LIMIT 10", "items")
def page_limit_offset(spark, d):
    return items(spark, d).orderBy(F.desc("published_at"), "id").offset(20).limit(10).select("id", "title")


@query("SELECT DISTINCT source_title FROM items", "items")
def distinct_values(spark, d):
    return items(spark, d).select("source_title").distinct()


@query("SELECT id, published_at FROM items ORDER BY published_at DESC, id LIMIT 15", "items")
def topk_recent(spark, d):
    return items(spark, d).orderBy(F.desc("published_at"), "id").limit(15).select("id", "published_at")


# -- writes, as the table after the write -----------------------------------------


def _papers(spark, d):
    """A table of documents with even ids, and a batch with some of them again, twice."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("title"), F.col("n_chars").cast("long").alias("body"))
    table = docs.where("key % 2 = 0")
    one = docs.where("key % 3 = 0").select("key", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("key") % 5 == 0, F.col("body") + 1).alias("body"), F.lit(1).alias("seq"))
    two = docs.where("key % 9 = 0").select("key", F.concat(F.lit("newer "), "title").alias("title"), F.lit(None).cast("long").alias("body"), F.lit(2).alias("seq"))
    return table, one.unionByName(two)


def _stored(spark, d, mode):
    """The batch put into a stored table, and put again, as a replay does."""
    rows, batch = _papers(spark, d)
    table = SnapshotTable(spark, new_place(spark, "papers"), ["key"])
    table.upsert(rows.withColumn("seq", F.lit(0)), "seq")
    for _ in range(2):
        table.upsert(batch, "seq", mode, keep_if_null=["body"])
    return table.read()


PAPERS = """WITH docs AS (SELECT doc_id AS key, source AS title, n_chars AS body FROM documents), old AS (SELECT * FROM docs WHERE key % 2 = 0),
batch AS (SELECT key, 'new ' || title AS title, CASE WHEN key % 5 = 0 THEN body + 1 END AS body, 1 AS seq FROM docs WHERE key % 3 = 0
  UNION ALL SELECT key, 'newer ' || title, NULL, 2 FROM docs WHERE key % 9 = 0),
last AS (SELECT * FROM batch b WHERE seq = (SELECT max(seq) FROM batch c WHERE c.key = b.key)) """


@query(PAPERS + "SELECT key, title, body FROM last UNION ALL SELECT key, title, body FROM old WHERE key NOT IN (SELECT key FROM last)")
def sink_upsert_replace(spark, d):
    return _stored(spark, d, "replace")


@query(PAPERS + """SELECT key, title, coalesce(body, (SELECT body FROM old WHERE old.key = last.key)) AS body FROM last
  UNION ALL SELECT key, title, body FROM old WHERE key NOT IN (SELECT key FROM last)""")
def sink_upsert_merge(spark, d):
    return _stored(spark, d, "merge")


@query(PAPERS + """SELECT key, title, body FROM old UNION ALL SELECT key, title, body FROM batch
  WHERE seq = 1 AND key NOT IN (SELECT key FROM old)""")
def sink_insert_ignore(spark, d):
    return _stored(spark, d, "ignore")


@query(PAPERS + "SELECT key, title, body FROM old WHERE key NOT IN (SELECT key FROM batch)")
def sink_delete(spark, d):
    table, batch = _papers(spark, d)
    return upserts.delete(table, batch, ["key"])


@query(PAPERS + """SELECT o.key, coalesce(l.title, o.title) AS title, CASE WHEN l.key IS NULL THEN o.body ELSE l.body END AS body
  FROM old o LEFT JOIN last l ON l.key = o.key""")
def sink_update(spark, d):
    table, batch = _papers(spark, d)
    return upserts.update(table, upserts.last_of(batch, ["key"], "seq"), ["key"], ["title", "body"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS used FROM events GROUP BY 1")
def sink_counter_upsert(spark, d):
    log = read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).alias("calls"))
    return upserts.counters(log, "day", "calls")


@query("SELECT key, title, body, NULL::VARCHAR AS full_text FROM (SELECT doc_id AS key, source AS title, n_chars AS body FROM documents WHERE doc_id % 2 = 0)")
def ddl_migrate(spark, d):
    table, _ = _papers(spark, d)
    wider = spark.createDataFrame([], table.schema.add("full_text", "string"))
    return table.unionByName(wider, allowMissingColumns=True)


@query("""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9-]', '-', 'g') || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '.txt' END AS filename, CASE WHEN page_id % 2 = 0 THEN '# **Page** *' || page_id || '*' ELSE 'Page ' || page_id END AS body FROM pages""")
def sink_download(spark, d):
    """Markdown as it is, or as plain text."""
    even, made = F.col("page_id") % 2 == 0, F.concat(F.lit("# **Page** *"), F.col("page_id").cast("string"), F.lit("*"))
    name = F.concat(F.regexp_replace(F.lower("url"), "[^a-z0-9-]", "-"), F.when(even, ".md").otherwise(".txt"))
    return read(spark, d, "pages").select("page_id", name.alias("filename"), F.when(even, made).otherwise(text.strip_formatting(made)).alias("body"))


@query("SELECT doc_id AS item_id, source AS name FROM documents UNION ALL SELECT page_id, url FROM pages")
def union_all(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("name"))
    return docs.unionByName(read(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.col("url").alias("name")))
