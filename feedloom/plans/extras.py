"""Further entries: requests, caches, appends, feeds and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.operators import search
from feedloom.plans.ranked import CORE, DIVERSE, RANKED, TERMS
from feedloom.plans.registry import QUERIES, query
from feedloom.plans.requests import Corpus, Papers, clamped, days_of
from feedloom.plans.searches import RETRIEVE
from feedloom.sources import items as feeds
from feedloom.sources import landed, upserts
from feedloom.sources.items import AS_OF, DAY, query_vector, read, scores, text_items, vectors
from feedloom.sources.places import new_place
from feedloom.sources.versions import SnapshotTable
from feedloom.streaming import ingest

EACH = dict.fromkeys(config.CATEGORIES, TERMS)


def corpus(spark, d) -> Corpus:
    return Corpus(text_items(spark, d), scores(spark, d), vectors(spark, d), AS_OF)


MONTH_CAP = RANKED + """, capped AS (SELECT *, (SELECT count(*) FROM placed q WHERE q.category = p.category AND q.source_title = p.source_title AND q.rank <= p.rank) AS in_source FROM placed p WHERE category = 'research'),
first AS (SELECT *, row_number() OVER (ORDER BY rank) AS position FROM capped WHERE in_source <= 8 QUALIFY position <= 15) """


@query(MONTH_CAP + "SELECT position, id, source_title, round(final, 3) AS final FROM first", "items scores firsts")
def api_items(spark, d):
    return corpus(spark, d).list_items("research", "month", 15, EACH, core_terms=CORE).select("position", "id", "source_title", "final")


@query(RANKED + "SELECT category, rank, id, round(final, 3) AS final FROM placed WHERE rank <= 5", "items scores firsts")
def api_digest(spark, d):
    return corpus(spark, d).digest("month", 5, EACH, core_terms=CORE).select("category", "rank", "id", "final")


@query("""WITH t AS (SELECT id, lower(title) AS ti, lower(title || ' ' || summary) AS tx FROM items WHERE published_at >= 1767225600 - 30 * 86400 AND category = 'ai_news'),
s AS (SELECT id, CASE WHEN contains(ti, 'then') THEN 100 ELSE 0 END + len(regexp_extract_all(ti, '\\bthen\\b')) * 30 + (len(regexp_extract_all(ti, 'then')) - len(regexp_extract_all(ti, '\\bthen\\b'))) * 10
  + (len(regexp_extract_all(tx, '\\bthen\\b')) - len(regexp_extract_all(ti, '\\bthen\\b'))) * 5 + least(len(regexp_extract_all(tx, 'then')) - len(regexp_extract_all(tx, '\\bthen\\b')) - (len(regexp_extract_all(ti, 'then')) - len(regexp_extract_all(ti, '\\bthen\\b'))), 10) * 2 AS score FROM t)
SELECT id, score::BIGINT AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 12""", "items")
def api_search(spark, d):
    return corpus(spark, d).find("then", "keyword", "month", "ai_news", 12).select("id", F.col("score").cast("long").alias("score"))


@query(RETRIEVE.replace("30 * 86400", "90 * 86400").replace("LIMIT 200", "LIMIT 40") + "SELECT p.id, round(0.7 * final + 0.3 * n.c, 6) AS final FROM placed p JOIN near n USING (id) ORDER BY round(0.7 * final + 0.3 * n.c, 9) DESC, id LIMIT 20", "items scores firsts")
def api_ask(spark, d):
    return corpus(spark, d).ask(query_vector(spark, d), "all", None, 20, EACH, core_terms=CORE).select("id", F.round("final", 6).alias("final"))


PICK = """, p3 AS (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY r) AS s FROM p1),
first AS (SELECT *, row_number() OVER (ORDER BY r) AS position FROM p3 WHERE s <= 3 QUALIFY position <= {most}),
rest AS (SELECT p3.*, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY r) AS position FROM p3 WHERE id NOT IN (SELECT id FROM first) QUALIFY position <= {least}),
picked AS (SELECT * FROM first UNION ALL SELECT * FROM rest) """

ASKED = RANKED + """, tagged AS (SELECT p.*, CASE WHEN agentic THEN 0.5 ELSE 0 END AS tm, (CASE WHEN contains(lower(p.title || ' ' || p.summary), 'agent') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(p.title || ' ' || p.summary), 'then') THEN 0.5 ELSE 0 END) AS tp
  FROM placed p WHERE category IN ('research', 'ai_news') AND length(summary) <= 50000),
aligned AS (SELECT *, (least(1.0, tm) * 0.5 + least(1.0, tp) * 0.5)::DOUBLE AS a FROM tagged),
again AS (SELECT *, final * CASE WHEN a > 0.5 THEN 4 + a * 4 WHEN a > 0.3 THEN 2.5 + a * 4 WHEN a > 0.1 THEN 1.5 + a * 5 ELSE 0.3 END AS adjusted FROM aligned),
p1 AS (SELECT *, row_number() OVER (ORDER BY round(adjusted, 9) DESC, id) AS r FROM again) """


@query(ASKED + PICK.format(most=16, least=11) + "SELECT position, id, category, round(adjusted, 6) AS final FROM picked", "items scores firsts")
def api_newsletter(spark, d):
    rows = corpus(spark, d).newsletter(["research", "ai_news"], "month", 20, "agents then", ("agent", "then"), terms=EACH, core_terms=CORE)
    return rows.select("position", "id", "category", F.round("final", 6).alias("final"))


EPISODE = RANKED + """, p1 AS (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'ai_news' THEN 0 ELSE 1 END, round(final, 9) DESC, id) AS r FROM placed WHERE category IN ('research', 'ai_news')) """ + PICK.format(most=12, least=10)


@query(EPISODE + """, d AS (SELECT *, row_number() OVER (ORDER BY position) AS k FROM picked WHERE floor(final * 10 + 0.5) >= 3)
SELECT id, title, position, CASE WHEN k <= 4 THEN 'segment' WHEN k <= 7 THEN 'lightning' ELSE 'cut' END AS band FROM d""", "items scores firsts")
def api_podcast(spark, d):
    """Without a prompt the categories come one after the other."""
    base = corpus(spark, d)
    base.items = base.items.withColumn("url", F.concat(F.lit("https://x.example/"), F.col("id").cast("string")))
    made = base.podcast(["ai_news", "research"], "month", 12, terms=EACH, core_terms=CORE)
    return made["rundown"].select("id", "title", "position", "band")


@query(RANKED + "SELECT rank, id, round(final, 6) AS final, round(bm25, 6) AS bm25, CASE WHEN scored THEN 1767225600 - 10 * 86400 END AS stored_at FROM placed WHERE category = 'research' AND rank <= 40", "items scores firsts")
def api_ranking_debug(spark, d):
    rows = corpus(spark, d).ranking_debug("research", "month", 40, terms=EACH, core_terms=CORE)
    return rows.select("rank", "id", F.round("final", 6).alias("final"), F.round("bm25", 6).alias("bm25"), "stored_at")


def _library(spark, d):
    """Parts as papers, in twenty libraries."""
    parts = read(spark, d, "part")
    key = F.col("p_partkey")
    papers = parts.select(key.cast("string").alias("bibcode"), F.col("p_name").alias("title"), F.to_json(F.array("p_brand", "p_type", "p_name", "p_brand")).alias("authors"), F.col("p_type").alias("abstract"), key.alias("fetched_at"))
    links = parts.select(F.concat(F.lit("Library "), (key % 20).cast("string")).alias("library_id"), key.cast("string").alias("bibcode"), F.floor(key / 20).alias("position"))
    return Papers(papers, links, "https://papers.example/abs/")


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_type ILIKE '%s%' OR p_name ILIKE '%s%' OR p_brand ILIKE '%s%' ORDER BY p_partkey DESC LIMIT 10), n AS (SELECT *, row_number() OVER (ORDER BY p_partkey DESC) AS n FROM p)
SELECT n, p_partkey::VARCHAR AS bibcode, '[' || n || '] Bibcode: ' || p_partkey || chr(10) || 'Title: ' || p_name || chr(10) || 'Authors: ' || p_brand || ', ' || p_type || ', ' || p_name || ' et al.' || chr(10) || 'Abstract: ' || p_type AS entry FROM n""")
def api_papers_context(spark, d):
    return _library(spark, d).context("s")


@query("""WITH p AS (SELECT p_partkey FROM part WHERE p_partkey % 20 = 3 ORDER BY p_partkey DESC LIMIT 10), n AS (SELECT *, row_number() OVER (ORDER BY p_partkey DESC) AS n FROM p)
SELECT q, n, p_partkey::VARCHAR AS bibcode, 'https://papers.example/abs/' || p_partkey AS url FROM n JOIN (VALUES (1, 2), (1, 1), (2, 4)) c(q, cited) ON cited = n""")
def api_papers_ask(spark, d):
    """Two answers with citations, some of them of papers that the context lacks."""
    papers = _library(spark, d)
    answers = spark.createDataFrame([(1, "As [2] says, and [1], and [2] again, not [99] or [0]."), (2, "Only [4].")], "q int, answer string")
    return papers.cited(answers, papers.context("", "Library 3")).select("q", F.col("n").cast("long").alias("n"), "bibcode", "url")


@query("""SELECT p_partkey // 20 AS position, p_partkey::VARCHAR AS bibcode, p_name AS title, 'https://papers.example/abs/' || p_partkey AS url, (SELECT count(*) FROM part WHERE p_partkey % 20 = 7) AS total, (SELECT count(*) FROM part WHERE p_partkey % 20 = 7) > 15 AS has_more
FROM part WHERE p_partkey % 20 = 7 AND p_partkey // 20 >= 5 AND p_partkey // 20 < 15""")
def api_library(spark, d):
    return _library(spark, d).library("Library 7", 5, 10).select("position", "bibcode", "title", "url", "total", "has_more")


@query("SELECT 'Library ' || p_partkey % 20 AS library_id, count(*) AS papers FROM part GROUP BY 1")
def api_libraries(spark, d):
    return _library(spark, d).libraries()


@query(RANKED + """, long AS (SELECT 'final' AS metric, final::DOUBLE AS v FROM placed WHERE category = 'research' UNION ALL SELECT 'bm25', bm25 FROM placed WHERE category = 'research' UNION ALL SELECT 'llm', llm FROM placed WHERE category = 'research'
  UNION ALL SELECT 'recency', recency FROM placed WHERE category = 'research' UNION ALL SELECT 'boost', boost FROM placed WHERE category = 'research'),
o AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n FROM long)
SELECT metric, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, round(max(v) FILTER (WHERE k = n // 2), 6) AS median FROM o GROUP BY metric""", "items scores firsts")
def api_score_analytics(spark, d):
    rows = corpus(spark, d).score_analytics("research", "month", terms=EACH, core_terms=CORE)
    return rows.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "median")])


@query("""SELECT 'raw' AS metric, count(*)::DOUBLE AS value FROM items UNION ALL SELECT 'normalised', count(*)::DOUBLE FROM items WHERE trim(title) <> '' UNION ALL SELECT 'categorised', count(*)::DOUBLE FROM items WHERE title <> '' AND category = 'research'
UNION ALL SELECT 'recent', count(*)::DOUBLE FROM items WHERE title <> '' AND category = 'research' AND published_at >= 1767225600 - 30 * 86400""", "items")
def api_stages(spark, d):
    return corpus(spark, d).stages("research", "month")


PERIODS, ROUTES = ["day", "week", "month", "all", "year"], ["items", "search", "ask", "ranking", "analytics", "debug", "newsletter", "podcast"]


@query(f"""WITH a AS (SELECT doc_id, ({PERIODS})[doc_id % 5 + 1] AS period, ({ROUTES})[doc_id // 5 % 8 + 1] AS route FROM documents)
SELECT doc_id, route, period, CASE WHEN route IN ('items', 'search', 'ask') THEN CASE period WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'all' THEN 90 ELSE CASE WHEN route <> 'items' THEN 7 END END
  WHEN route IN ('newsletter', 'podcast') THEN CASE period WHEN 'week' THEN 7 ELSE 30 END ELSE CASE period WHEN 'month' THEN 30 ELSE 7 END END AS days FROM a""")
def period_resolution(spark, d):
    """What each kind of request takes a period for; a request a document."""
    n = F.col("doc_id")
    rows = read(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, PERIODS)), (n % 5 + 1).cast("int")).alias("period"), F.element_at(F.array(*map(F.lit, ROUTES)), (F.floor(n / 5) % 8 + 1).cast("int")).alias("route"))
    return rows.withColumn("days", days_of(F.col("route"), F.col("period")))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN (o_totalprice / 1000)::INTEGER - 60 END AS asked FROM orders)
SELECT o_orderkey, coalesce(greatest(1, least(50, asked)), 10) AS items, coalesce(greatest(1, least(100, asked)), 10) AS search, coalesce(greatest(1, least(20, asked)), 5) AS ask FROM o""")
def clamp_limit(spark, d):
    """Limits that requests ask for, or don't; a request an order."""
    asked = F.when(F.col("o_orderkey") % 7 > 0, F.rint(F.col("o_totalprice") / 1000).cast("int") - 60)  # halves to the even number, as SQL casts round
    rows = read(spark, d, "orders").select("o_orderkey", asked.alias("asked"))
    return rows.select("o_orderkey", *[clamped(F.col("asked"), 1, most, default).alias(name) for name, most, default in (("items", 50, 10), ("search", 100, 10), ("ask", 20, 5))])


# -- appends and caches -----------------------------------------------------------


def _appended(spark, rows, key):
    """Append to a table, twice, each with a replay that adds nothing, and read it back."""
    table = SnapshotTable(spark, new_place(spark, "appended"), key)
    for n in (0, 0, 1, 1, 0):
        table.append(rows, "batches", n)
    return table.read()


@query("SELECT item_id, scored_at, relevance FROM scores UNION ALL SELECT item_id, scored_at, relevance FROM scores", "scores")
def sink_append_scores(spark, d):
    return _appended(spark, scores(spark, d).select("item_id", "scored_at", "relevance"), ["item_id"])


@query(DIVERSE + "SELECT category, position, id, reason FROM chosen UNION ALL SELECT category, position, id, reason FROM chosen", "items scores firsts")
def sink_append_selections(spark, d):
    return _appended(spark, QUERIES["select_diverse"](spark, d).select("category", "position", "id", "reason"), ["id"])


@query("SELECT doc_id AS id, text FROM documents")
def sink_files(spark, d):
    """A table as JSON files, and read back."""
    path = new_place(spark, "files")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT doc_id AS key, 1767225600 + (doc_id % 7 - 3) * 200 + 300 AS expires_at, 1767225600 AS last_refresh_at, doc_id % 5 AS count FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1767225600 + 3600, 1767225600, 7 FROM documents WHERE doc_id % 2 = 1")
def cache_extend_set(spark, d):
    """Half of the entries live 300 seconds longer, the others are set anew for an hour."""
    n = F.col("doc_id")
    table = read(spark, d, "documents").select(n.alias("key"), (F.lit(AS_OF) + (n % 7 - 3) * 200).alias("expires_at"), F.lit(AS_OF).cast("long").alias("last_refresh_at"), (n % 5).alias("count"))
    longer = table.where("key % 2 = 0").select("key", (F.col("expires_at") + 300).alias("expires_at"))
    fresh = table.where("key % 2 = 1").select("key", F.lit(AS_OF + 3600).cast("long").alias("expires_at"), F.lit(AS_OF).cast("long").alias("last_refresh_at"), F.lit(7).cast("long").alias("count"), F.lit(1).alias("seq"))
    return upserts.replace(upserts.update(table, longer, ["key"], ["expires_at"]), fresh, ["key"], "seq")


@query("SELECT doc_id AS key, 1767225600 + (doc_id % 7 - 3) * 200 <= 1767225600 AS expired FROM documents")
def cache_expired(spark, d):
    at = F.lit(AS_OF) + (F.col("doc_id") % 7 - 3) * 200
    return read(spark, d, "documents").select(F.col("doc_id").alias("key"), (at <= AS_OF).alias("expired"))


@query("SELECT doc_id AS key, CASE WHEN doc_id % 7 = 2 THEN 0 ELSE 1767225600 END AS expires_at FROM documents")
def cache_invalidate(spark, d):
    """Entries of one category (by the key's ending) expire at once."""
    name = F.concat(F.lit("items_7d_"), F.element_at(F.array(*map(F.lit, config.CATEGORIES)), (F.col("doc_id") % 7 + 1).cast("int")))
    hit = F.regexp_extract(name, r"^items_[0-9]+d_(.+)$", 1) == "tech_articles"
    return read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.when(hit, 0).otherwise(AS_OF).alias("expires_at"))


@query("SELECT vec_id AS item_id, len(embedding)::INTEGER AS size, 4 * len(embedding)::INTEGER AS bytes, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vec_codec(spark, d):
    """Vectors to little-endian 32-bit floats in a binary, and back."""
    coded = vectors(spark, d).select("item_id", search.encode_vector("embedding").alias("coded"))
    rows = coded.select("item_id", F.octet_length("coded").alias("bytes"), search.decode_vector("coded").alias("back"))
    return rows.select("item_id", F.size("back").alias("size"), "bytes", F.round(F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


# -- feeds ------------------------------------------------------------------------


def _articles(spark, d):
    """Documents as landed feed articles."""
    n = F.col("doc_id")
    return read(spark, d, "documents").select(
        n.cast("string").alias("id"), F.when(n % 4 != 0, F.regexp_extract("text", r"^[^\n]*", 0)).alias("title"), F.lit("a").alias("author"), (F.lit(AS_OF) - n % 90 * DAY).alias("published"), F.lit(0).cast("long").alias("updated"),
        F.array(F.lit("user/-/state/read"), F.when(n % 2 == 0, F.lit("user/1/label/Papers")).otherwise("user/1/label/Misc")).alias("categories"),
        F.when(n % 3 == 0, F.array(F.struct(F.concat(F.lit("https://c.example/"), n.cast("string")).alias("href")))).alias("canonical"),
        F.when(n % 3 == 1, F.array(F.struct(F.concat(F.lit("https://a.example/"), n.cast("string")).alias("href"), F.lit("text/html").alias("type")))).alias("alternate"),
        F.struct(F.concat(F.lit('<a href="https://agg.example/x">x</a> <a href="https://body.example/'), n.cast("string"), F.lit('">y</a> '), "text").alias("content")).alias("summary"),
        F.struct(F.col("source").alias("streamId"), F.concat(F.lit("Feed "), "source").alias("title"), F.lit("https://f.example").alias("htmlUrl")).alias("origin"),
    )


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE split_part(text, chr(10), 1) END AS title, CASE doc_id % 3 WHEN 0 THEN 'https://c.example/' WHEN 1 THEN 'https://a.example/' ELSE 'https://body.example/' END || doc_id AS url,
  'Feed ' || source AS source_title, CASE WHEN doc_id % 2 = 0 THEN 'research' ELSE 'newsletters' END AS category FROM documents""")
def norm_article(spark, d):
    rows = feeds.categorize(feeds.normalize(_articles(spark, d), ("agg.example",)), {"Papers": "research"})
    return rows.select("id", "title", "url", "source_title", "category")


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'research' ELSE 'podcasts' END AS category FROM documents""")
def categorize_override(spark, d):
    return feeds.categorize(feeds.normalize(_articles(spark, d)), {"Papers": "research", "Misc": "podcasts"}).select("id", "category")


@query("SELECT doc_id::VARCHAR AS id, 'Feed ' || source AS source_title, 1767225600 - doc_id % 90 * 86400 AS published_at, 2 AS labels FROM documents")
def src_feed_page(spark, d):
    """Landed pages of feed articles, read with an explicit schema."""
    path = new_place(spark, "feed")
    _articles(spark, d).write.json(path)
    return feeds.normalize(feeds.read_feed(spark, path)).select("id", "source_title", "published_at", F.size("categories").alias("labels"))


# -- landed replies -----------------------------------------------------------------


def _landed(spark, rows, name, schema):
    path = new_place(spark, name)
    rows.write.json(path)
    return landed.replies(spark, path, schema)


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN '(Untitled)' ELSE split_part(text, chr(10), 1) END AS title, 'Feed ' || source AS source_title,
  CASE doc_id % 3 WHEN 0 THEN 'https://c.example/' || doc_id WHEN 1 THEN 'https://a.example/' || doc_id ELSE '#' END AS url, 1767225600 - doc_id % 90 * 86400 AS published_at FROM documents WHERE length(split_part(text, chr(10), 1)) > 0 OR doc_id % 4 = 0""")
def src_starred(spark, d):
    """Pages of ten starred articles."""
    pages = _articles(spark, d).where(F.col("title").isNull() | (F.length("title") > 0)).groupBy(F.floor(F.col("id").cast("long") / 10).alias("page")).agg(F.collect_list(F.struct(*feeds.FEED_ARTICLE.names)).alias("items"))
    rows = landed.starred(_landed(spark, pages.select("items", F.col("page").cast("string").alias("continuation")), "starred", landed.STARRED))
    return rows.select("id", "title", "source_title", "url", "published_at")


@query("SELECT 'feed/' || s_suppkey AS stream_id, s_name AS title, 'https://f.example/' || s_suppkey AS html_url, 'Group ' || s_nationkey AS label FROM supplier")
def src_subscriptions(spark, d):
    n = F.col("s_suppkey").cast("string")
    label = F.concat(F.lit("Group "), F.col("s_nationkey").cast("string"))
    one = F.struct(F.concat(F.lit("feed/"), n).alias("id"), F.col("s_name").alias("title"), F.lit("u").alias("url"), F.concat(F.lit("https://f.example/"), n).alias("htmlUrl"),
                   F.array(F.struct(F.lit("user/1/label/x").alias("id"), label.alias("label"))).alias("categories"))
    pages = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(one).alias("subscriptions"))
    rows = landed.subscriptions(_landed(spark, pages.select("subscriptions"), "subscriptions", landed.SUBSCRIPTIONS))
    return rows.select("stream_id", "title", "html_url", F.get("labels", F.lit(0)).alias("label"))


@query("SELECT 'user/1/label/' || n_name AS tag_id, n_name AS label FROM nation")
def src_tags(spark, d):
    pages = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("user/1/label/"), "n_name").alias("id"), F.lit("0").alias("sortid"))).alias("tags"))
    return landed.tags(_landed(spark, pages.select("tags"), "tags", landed.TAGS))


@query("SELECT p_partkey::VARCHAR AS bibcode, p_name AS title, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS authors, p_size::VARCHAR AS pubdate FROM part")
def src_papers_api(spark, d):
    one = F.struct(F.col("p_partkey").cast("string").alias("bibcode"), F.array("p_name").alias("title"), F.array("p_brand", "p_type").alias("author"), F.col("p_size").cast("string").alias("pubdate"))
    pages = read(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("page")).agg(F.collect_list(one).alias("docs"))
    rows = landed.papers(_landed(spark, pages.select(F.struct("docs").alias("response")), "papers", landed.PAPERS))
    return rows.select("bibcode", "title", "authors", "pubdate")


@query("WITH n AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS position FROM supplier) SELECT s_nationkey::VARCHAR AS library_id, position::INTEGER AS position, s_suppkey::VARCHAR AS bibcode FROM n WHERE position >= 1 AND position < 4")
def src_library_items(spark, d):
    """The second to fourth paper of each library."""
    keys = F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: k.cast("string"))
    pages = read(spark, d, "supplier").groupBy("s_nationkey").agg(keys.alias("documents"))
    return landed.library_items(_landed(spark, pages.select(F.col("s_nationkey").cast("string").alias("library_id"), "documents"), "libraries", landed.LIBRARY), 1, 3)


@query("SELECT page_id, length(html) >= 100 AS fetched FROM pages UNION ALL SELECT -1 - page_id, length(url) >= 100 FROM pages")
def src_web_page(spark, d):
    """Pages, and as too short ones their urls."""
    pages = read(spark, d, "pages")
    rows = pages.select("page_id", "html").unionByName(pages.select((-1 - F.col("page_id")).alias("page_id"), F.col("url").alias("html")))
    return rows.select("page_id", landed.page_text(F.col("html")).isNotNull().alias("fetched"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN nullif(trim(regexp_replace(replace(text, '<', ' '), '\\s+', ' ', 'g')), '') END AS abstract FROM documents")
def src_arxiv(spark, d):
    xml = F.concat(F.lit("<entry>"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<summary>\n  "), F.replace(F.col("text"), F.lit("<"), F.lit(" ")), F.lit("\n</summary>"))).otherwise(""), F.lit("</entry>"))
    return read(spark, d, "documents").select("doc_id", landed.arxiv_abstract(xml).alias("abstract"))


# -- syncs through the streaming ingest ---------------------------------------------

AGE = "doc_id % 90"


def _land(spark, d, where, folder, title=None):
    rows = _articles(spark, d).where(where)
    rows = rows.withColumn("title", F.lit(title)) if title else rows
    rows.write.mode("append").json(folder)


def _sync_result(table):
    return table.read().select("id", "title", "category", "published_at")


SYNCED = """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'Untitled' ELSE split_part(text, chr(10), 1) END AS title, CASE WHEN doc_id % 2 = 0 THEN 'research' ELSE 'newsletters' END AS category, 1767225600 - doc_id % 90 * 86400 AS published_at FROM documents """


def _streamed(spark):
    place = new_place(spark, "sync")
    return f"{place}/landing", ingest.KeyedTable(spark, f"{place}/table"), f"{place}/check"


FOLDERS = {"Papers": "research"}


@query(SYNCED + f"WHERE {AGE} < 30")
def stream_daily_sync(spark, d):
    """A first run that catches up on 30 days, then one after the newest article: what
    comes late, with another title here, is dropped; a new checkpoint loses nothing."""
    folder, table, check = _streamed(spark)
    _land(spark, d, "id % 90 >= 10", folder)
    ingest.daily_sync(spark, folder, table, check, AS_OF, FOLDERS, catch_up_days=30)
    _land(spark, d, "id % 90 IN (10, 11)", folder, "late")
    _land(spark, d, "id % 90 < 10", folder)
    ingest.daily_sync(spark, folder, table, check + "-new", AS_OF, FOLDERS)
    return _sync_result(table)


@query(SYNCED + f"WHERE {AGE} < 7")
def stream_weekly_sync(spark, d):
    """A week back, whatever the table has; a run beyond its budget takes nothing."""
    folder, table, check = _streamed(spark)
    _land(spark, d, "true", folder)
    ingest.weekly_sync(spark, folder, table, check, AS_OF, FOLDERS, calls_used=20)
    ingest.weekly_sync(spark, folder, table, check + "-over", AS_OF + 60 * DAY, FOLDERS, calls_used=95)
    return _sync_result(table)


@query(SYNCED + f"WHERE {AGE} <= 2")
def stream_48h_sync(spark, d):
    folder, table, _ = _streamed(spark)
    _land(spark, d, "true", folder)
    ingest.recent_sync(spark, folder, table, AS_OF, FOLDERS)
    return _sync_result(table)


@query(SYNCED + "WHERE source IN ('src1', 'src2')")
def stream_per_category(spark, d):
    """All articles of some streams, one stream after the other."""
    folder, table, _ = _streamed(spark)
    _land(spark, d, "true", folder)
    for stream in ("src1", "src2"):
        ingest.stream_sync(spark, folder, table, FOLDERS, (stream,))
    return _sync_result(table)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY 1")
def stream_budget(spark, d):
    """Calls of each day, counted by a stream with a watermark."""
    place = new_place(spark, "budget")
    read(spark, d, "events").select("event_id", "ts").write.parquet(f"{place}/landing")
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{place}/landing")
    days = ingest.calls_a_day(stream).writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/days"))
    days.option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day timestamp, used long").parquet(f"{place}/days").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "used")


@query("SELECT event_id FROM events")
def stream_dedupe(spark, d):
    """Each event lands twice and counts once."""
    place = new_place(spark, "dedupe")
    rows = read(spark, d, "events").select("event_id", "ts")
    rows.unionByName(rows).write.parquet(f"{place}/landing")
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{place}/landing")
    once = ingest.deduplicated(stream, "event_id").writeStream.format("parquet").option("checkpointLocation", f"{place}/check")
    once.trigger(availableNow=True).start(f"{place}/once").awaitTermination()
    return spark.read.schema("event_id long, ts timestamp").parquet(f"{place}/once").select("event_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def json_props(spark, d):
    return read(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int") > 50).select("event_id")
