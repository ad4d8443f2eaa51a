"""Queries over what is stored: indexes, kept state, statuses, and whole issues."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import text_of
from feedloom.operators import replies, search
from feedloom.plans.extras import EACH, FOLDERS, SYNCED, _articles, _land, _streamed, _sync_result, corpus
from feedloom.plans.ranked import BM25, CORE, RANKED, TERMS, URL_KEY
from feedloom.plans.registry import query
from feedloom.plans.searches import KEY
from feedloom.plans.texts import WHITE
from feedloom.sources.items import AS_OF, DAY, items, read, scores, text_items, vectors, with_urls
from feedloom.sources.kept import ScoreState, VectorStore
from feedloom.sources.places import new_place
from feedloom.sources.ratings import Ratings, refresh_feeds
from feedloom.sources.term_index import TermIndex
from feedloom.sources.text_index import TextIndex
from feedloom.sources.vector_index import VectorIndex
from feedloom.sources.versions import SnapshotTable
from feedloom.streaming import ingest

SINCE = AS_OF - 30 * DAY


# -- indexes ----------------------------------------------------------------------


def _term_index(spark, d):
    """All items, in two appends."""
    index, rows = TermIndex(spark, new_place(spark, "terms")), text_items(spark, d)
    for half in (0, 1):
        index.append(rows.where(F.col("id") % 2 == half), text_of("title", "summary", "source_title", "category"), F.col("category"), F.col("published_at"))
    return index


@query(f"WITH {BM25} SELECT id, category, round(s, 6) AS raw, round(bm25, 6) AS bm25 FROM bm", "items")
def bm25_index(spark, d):
    """bm25_score from a stored index: no text is read for the scores."""
    rows = _term_index(spark, d).scores(dict.fromkeys(config.CATEGORIES, TERMS), SINCE)
    return rows.select("id", F.col("group").alias("category"), F.round("bm25_raw", 6).alias("raw"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {BM25} SELECT category, id, round(s, 6) AS raw FROM bm WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY category ORDER BY round(s, 9) DESC, id) <= 10", "items")
def bm25_index_topk(spark, d):
    """The best ten of each category, from the blocks that can have one of them."""
    rows = _term_index(spark, d).top(dict.fromkeys(config.CATEGORIES, TERMS), 10, SINCE)
    return rows.select(F.col("group").alias("category"), "id", F.round("bm25_raw", 6).alias("raw"))


def _text_index(spark, d):
    index = TextIndex(spark, new_place(spark, "grams"))
    index.append(text_items(spark, d).select("id", "title", "source_title", "summary", "category", "published_at"), F.lower(text_of("title", "summary")))
    return index


KEY_RARE = KEY.replace("'the then an'", "'rethion lyesor'").replace("('the', 'the'), ('then', 'then'), ('an', 'an')", "('rethion', 'rethion'), ('lyesor', 'lyesor')")


@query(KEY_RARE + "SELECT * FROM kw ORDER BY score DESC, id LIMIT 40", "items")
def search_keyword_index(spark, d):
    """search_keyword over the blocks that can hold a term."""
    rows = search.search_keyword(_text_index(spark, d).candidates(["rethion", "lyesor"]), "rethion lyesor", 40)
    return rows.select("id", F.col("score").cast("long").alias("score"), "similarity")


@query("""SELECT id, source_title FROM items WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'esandha') OR contains(translate(summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'esandha') ORDER BY published_at DESC, id""", "items")
def filter_like_index(spark, d):
    """A substring of whole texts, of which only those of candidate blocks are read."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = _text_index(spark, d).candidates(["esandha"])
    return rows.where(F.translate("title", upper, lower).like("%esandha%") | F.translate("summary", upper, lower).like("%esandha%")).select("id", "source_title")


@query(None)
def vec_index_search(spark, d):
    """The ten nearest of every fiftieth vector, from an inverted file (recall is tested against the whole scan)."""
    index, rows = VectorIndex(spark, new_place(spark, "vectors")), vectors(spark, d)
    index.build(rows)
    found = index.search(rows.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q")), 10)
    return found.select("query_id", "item_id", F.round("cosine", 6).alias("cosine"))


# -- kept state -------------------------------------------------------------------


def _score_state(spark, d):
    """All scores in three batches, of which one comes twice."""
    state, rows = ScoreState(spark, new_place(spark, "scores")), scores(spark, d)
    for n, part in enumerate((0, 1, 1, 2)):
        state.append(rows.where((F.col("item_id") + F.floor(F.col("scored_at") / DAY)) % 3 == part), "scores", min(n, part))
    return state


@query("SELECT i.id, f.relevance, f.scored_at FROM items i LEFT JOIN lasts f ON f.item_id = i.id", "items scores lasts")
def join_latest_score_kept(spark, d):
    last = _score_state(spark, d).last().select(F.col("item_id").alias("id"), "relevance", "scored_at")
    return items(spark, d).select("id").join(last, "id", "left")


@query("SELECT i.id, f.relevance, f.usefulness FROM items i LEFT JOIN firsts f ON f.item_id = i.id", "items scores firsts")
def join_oldest_score_kept(spark, d):
    first = _score_state(spark, d).first().select(F.col("item_id").alias("id"), "relevance", "usefulness")
    return items(spark, d).select("id").join(first, "id", "left")


@query("SELECT run, CASE run WHEN 1 THEN (SELECT count(*) FROM items) WHEN 2 THEN 0 ELSE (SELECT count(*) FROM items WHERE id % 10 = 3) END AS made FROM (VALUES (1), (2), (3)) r(run)", "items")
def embed_kept(spark, d):
    """How many vectors a first run makes, a second, and one after a tenth of the texts changed."""
    store = VectorStore(spark, new_place(spark, "embedded"), lambda text: search.pseudo_embedding(text, 64))
    texts = text_items(spark, d).select(F.col("id").alias("item_id"), F.substring(F.concat_ws(" ", "title", "summary"), 1, 1000).alias("text"))
    changed = texts.withColumn("text", F.when(F.col("item_id") % 10 == 3, F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    return spark.createDataFrame([(n + 1, store.refresh(rows)) for n, rows in enumerate((texts, texts, changed))], "run int, made long")


@query("""WITH c AS (SELECT doc_id, list_reduce(list_transform(string_split(substr(concat_ws(' ', split_part(text, chr(10), 1), text), 1, 1000), ''), lambda x: unicode(x)::BIGINT), lambda h, u: CASE WHEN u < 65536 THEN (31 * h + u) % 4294967296
  ELSE (31 * ((31 * h + 55296 + (u - 65536) // 1024) % 4294967296) + 56320 + (u - 65536) % 1024) % 4294967296 END, 0::BIGINT) AS h FROM documents WHERE trim(text) <> '')
SELECT doc_id AS item_id, round(sin(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) + 73)::FLOAT::DOUBLE, 4) AS second FROM c""")
def join_anti_embeddings_kept(spark, d):
    """Vectors of items that lacked them, read back from the table that keeps them."""
    store = VectorStore(spark, new_place(spark, "embedded"), lambda text: search.pseudo_embedding(text, 64))
    texts = text_items(spark, d).where("trim(summary) <> ''").select(F.col("id").alias("item_id"), F.substring(F.concat_ws(" ", "title", "summary"), 1, 1000).alias("text"))
    store.refresh(texts.where("item_id % 3 = 0"))
    store.refresh(texts)
    return store.read().select("item_id", F.round(F.get("embedding", F.lit(1)).cast("double"), 4).alias("second"))


# -- requests ---------------------------------------------------------------------


@query("""SELECT 'category' AS kind, category AS name, count(*)::BIGINT AS value FROM items GROUP BY category UNION ALL SELECT 'embeddings', 'all', count(*) FROM embeddings
UNION ALL SELECT 'recent', title, published_at FROM (SELECT title, published_at, id FROM items ORDER BY published_at DESC, id LIMIT 10)""", "items")
def api_status(spark, d):
    """Items by category, vectors, and the ten newest items."""
    return corpus(spark, d).status()


@query("""WITH c AS (SELECT 'feeds' AS resource, doc_id, doc_id % 12 + 1 AS attempts, 1767225600 - doc_id % 30000 AS failed FROM documents),
t AS (SELECT *, failed + least(60 * pow(2, attempts - 1), 28800)::BIGINT AS retry_at FROM c),
f AS (SELECT *, 1767225600 - failed AS age, greatest(0, retry_at - 1767225600) AS wait FROM t)
SELECT doc_id, attempts, retry_at, CASE WHEN age < 60 THEN age || 's' WHEN age < 3600 THEN floor(age / 60 + 0.5)::BIGINT || 'm' ELSE floor(age / 3600 + 0.5)::BIGINT || 'h' END AS age,
  CASE WHEN wait < 60 THEN wait || 's' WHEN wait < 3600 THEN floor(wait / 60 + 0.5)::BIGINT || 'm' ELSE floor(wait / 3600 + 0.5)::BIGINT || 'h' END AS wait, retry_at <= 1767225600 AS can_retry FROM f""")
def backoff_status(spark, d):
    """Failures that cache keys tell of, with their next tries; other keys tell of none."""
    n = F.col("doc_id")
    key = F.concat(F.lit("backoff_feeds_attempts_"), (n % 12 + 1).cast("string"), F.lit("_lastFailure_"), (F.lit(AS_OF) - n % 30000).cast("string"))
    rows = read(spark, d, "documents").select("doc_id", key.alias("key"))
    found = replies.backoff_status(rows.unionByName(rows.withColumn("key", F.lit("items_7d_research"))), "key", AS_OF)
    return found.select("doc_id", F.col("attempts").cast("long").alias("attempts"), "retry_at", "age", "wait", "can_retry")


@query("""SELECT doc_id // 100 AS feeds_table, max(1767225600 - doc_id % 40000) AS last_refresh_at, count(*) AS count, max(1767225600 - doc_id % 40000) + 21600 AS expires_at, max(1767225600 - doc_id % 40000) + 21600 <= 1767225600 AS expired FROM documents GROUP BY 1""")
def feeds_cache(spark, d):
    """Each feed table's cache: how many feeds, when it was refreshed, and until when (six hours) it is good."""
    rows = read(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("feeds_table"), (F.lit(AS_OF) - F.col("doc_id") % 40000).alias("at"))
    return replies.feeds_cache(rows, ["feeds_table"], "at", AS_OF)


LONG = """, long AS (SELECT 'final' AS metric, final::DOUBLE AS v FROM placed WHERE category = 'research' UNION ALL SELECT 'bm25', bm25 FROM placed WHERE category = 'research' UNION ALL SELECT 'relevance', relevance FROM placed WHERE category = 'research'
  UNION ALL SELECT 'usefulness', CASE WHEN scored THEN (SELECT f.usefulness FROM firsts f WHERE f.item_id = placed.id) ELSE floor(bm25 * 10 + 0.5) END FROM placed WHERE category = 'research' UNION ALL SELECT 'recency', recency FROM placed WHERE category = 'research') """


@query(RANKED + LONG + """, e AS (SELECT metric, min(v) AS lo, max(v) AS hi, CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1 END AS span FROM long GROUP BY metric),
n AS (SELECT metric, least(9, floor((v - lo) / span * 10))::INTEGER AS bucket, count(*) AS n FROM long JOIN e USING (metric) GROUP BY ALL)
SELECT e.metric, b.bucket::INTEGER AS bucket, round(lo + span * b.bucket / 10, 6) AS low, coalesce(n.n, 0) AS n FROM e CROSS JOIN range(10) b(bucket) LEFT JOIN n ON n.metric = e.metric AND n.bucket = b.bucket""", "items scores firsts")
def api_score_histograms(spark, d):
    rows = corpus(spark, d).score_histograms("research", "month", terms=EACH, core_terms=CORE)
    return rows.select("metric", "bucket", F.round("low", 6).alias("low"), "n")


@query(RANKED + """SELECT source_title AS source, count(*) AS n, round(avg(final), 6) AS mean, round(max(final), 6) AS high, round(min(final), 6) AS low FROM placed WHERE category = 'research' GROUP BY source_title ORDER BY round(avg(final), 9) DESC, source_title LIMIT 10""", "items scores firsts")
def api_score_sources(spark, d):
    rows = corpus(spark, d).score_sources("research", "month", terms=EACH, core_terms=CORE)
    return rows.select("source", "n", *[F.round(c, 6).alias(c) for c in ("mean", "high", "low")])


# -- issues and episodes ----------------------------------------------------------

#: Selected items with their whole texts and the urls that no earlier item has.
ISSUE = RANKED + """, tagged AS (SELECT p.*, CASE WHEN agentic THEN 0.5 ELSE 0 END AS tm, (CASE WHEN contains(lower(p.title || ' ' || p.summary), 'agent') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(p.title || ' ' || p.summary), 'then') THEN 0.5 ELSE 0 END) AS tp
  FROM placed p WHERE category IN ('research', 'ai_news') AND length(summary) <= 50000),
aligned AS (SELECT *, (least(1.0, tm) * 0.5 + least(1.0, tp) * 0.5)::DOUBLE AS a FROM tagged),
again AS (SELECT *, final * CASE WHEN a > 0.5 THEN 4 + a * 4 WHEN a > 0.3 THEN 2.5 + a * 4 WHEN a > 0.1 THEN 1.5 + a * 5 ELSE 0.3 END AS adjusted FROM aligned)""" + f""", keyed AS (SELECT a.*, url, {URL_KEY} AS key FROM again a JOIN urls USING (id)),
once AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(adjusted, 9) DESC, id) AS dup FROM keyed QUALIFY dup = 1),
r1 AS (SELECT *, row_number() OVER (ORDER BY round(adjusted, 9) DESC, id) AS r FROM once),
r2 AS (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY r) AS s FROM r1),
first AS (SELECT *, row_number() OVER (ORDER BY r) AS position FROM r2 WHERE s <= 3 QUALIFY position <= 16),
picked AS (SELECT * FROM first UNION ALL SELECT r2.*, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY r) AS position FROM r2 WHERE id NOT IN (SELECT id FROM first) QUALIFY position <= 11),
c AS (SELECT *, CASE WHEN summary = '' THEN 'No summary available' WHEN contains(summary, '<') THEN trim(regexp_replace(replace(replace(replace(replace(regexp_replace(summary, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')) ELSE summary END AS c
  FROM picked WHERE starts_with(url, 'http') AND NOT regexp_matches(url, 'reddit\\.com/(r|u|user)/|news\\.google\\.com/rss/articles/', 'i')),
dig AS (SELECT *, trim(substr(c, 1, 100), {WHITE}) AS gist, CASE WHEN length(c) > 150 THEN trim(substr(c, 1, 150), {WHITE}) || '...' ELSE trim(c, {WHITE}) END AS bullet, floor(adjusted * 10 + 0.5)::BIGINT AS rel,
  CASE category WHEN 'research' THEN 0 ELSE 3 END AS p, CASE category WHEN 'research' THEN 'Research' ELSE 'AI News' END AS name FROM c)"""


def _issue(spark, d):
    base = corpus(spark, d)
    base.items = with_urls(base.items, spark, d)
    return base.newsletter_issue(["research", "ai_news"], "month", 20, "agents then", ("agent", "then"), terms=EACH, core_terms=CORE)


@query(ISSUE + """, e AS (SELECT *, '### [' || title || '](' || url || ')' || chr(10) || chr(10) || '*' || source_title || '*' || chr(10) || chr(10) || gist || chr(10) || chr(10) || '- ' || bullet || chr(10) || chr(10) AS entry FROM dig),
s AS (SELECT p, '## ' || name || chr(10) || chr(10) || string_agg(entry, '' ORDER BY -rel, title, entry) AS body FROM e GROUP BY p, name)
SELECT '# Digest' || chr(10) || chr(10) || string_agg(body, '' ORDER BY p) AS body FROM s""", "items scores firsts urls")
def newsletter_issue(spark, d):
    """A newsletter from ranking to text: selection, digests, url filter, rendering."""
    return _issue(spark, d)["markdown"].select("body")


@query(ISSUE + "SELECT position, id::VARCHAR AS id, category, url, gist, rel AS relevance FROM dig", "items scores firsts urls")
def newsletter_digests(spark, d):
    return _issue(spark, d)["digests"].select(F.col("position").cast("long").alias("position"), "id", "category", "url", "gist", "relevance")


@query(ISSUE + """, t AS (SELECT unnest(list_filter([CASE WHEN good THEN 'quality' END, CASE WHEN off_topic THEN 'off-topic' END, CASE WHEN agentic THEN 'agent' END], lambda x: x IS NOT NULL)) AS theme FROM dig WHERE scored)
SELECT theme, count(*) * CASE WHEN theme = 'agent' THEN 2.5 ELSE 1 END::DOUBLE AS weight FROM t GROUP BY theme""", "items scores firsts urls")
def newsletter_themes(spark, d):
    """Tags of an issue's digests with their frequencies."""
    return _issue(spark, d)["themes"]


EPISODE_TEXT = RANKED + """, r1 AS (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'ai_news' THEN 0 ELSE 1 END, round(final, 9) DESC, id) AS r FROM placed WHERE category IN ('research', 'ai_news')),
r2 AS (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY r) AS s FROM r1),
first AS (SELECT *, row_number() OVER (ORDER BY r) AS position FROM r2 WHERE s <= 3 QUALIFY position <= 12),
picked AS (SELECT * FROM first UNION ALL SELECT r2.*, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY r) AS position FROM r2 WHERE id NOT IN (SELECT id FROM first) QUALIFY position <= 10),
dig AS (SELECT *, CASE WHEN summary = '' THEN 'No summary available' ELSE summary END AS gist, row_number() OVER (ORDER BY position) AS k FROM picked WHERE floor(final * 10 + 0.5) >= 3),
seg AS (SELECT k, '## Relevant to code intelligence' || chr(10) || chr(10) || '**HOST:** ' || (['Let''s kick things off with', 'Moving on to', 'Next up,', 'Now let''s look at'])[k] || ' relevant to code intelligence. ' || substr(gist, 1, 150) || chr(10) || chr(10) || '[PAUSE]' || chr(10) || chr(10) AS part FROM dig WHERE k <= 4),
script AS (SELECT '[INTRO MUSIC]' || chr(10) || chr(10) || '**HOST:** Welcome to this week''s code intelligence digest. I''m your host.' || chr(10) || chr(10) || '**COHOST:** And I''m your co-host. Today we''re covering ' || (SELECT count(*) FROM dig) || ' stories on code search, agents, and developer tools.' || chr(10) || chr(10)
  || string_agg(part, '' ORDER BY k) || '**HOST:** That''s all for this week. Thanks for listening. Check the show notes for all links.' || chr(10) || chr(10) || '[OUTRO MUSIC]' AS script FROM seg),
timed AS (SELECT *, ceil(len(string_split_regex(script, '\\s+')) / 150.0::DOUBLE * 60)::BIGINT AS seconds FROM script),
dealt AS (SELECT k, floor((t.seconds - 60) / (SELECT count(*)::DOUBLE FROM seg) + 0.5)::BIGINT AS duration FROM timed t, seg) """


def _episode(spark, d):
    base = corpus(spark, d)
    base.items = base.items.withColumn("url", F.concat(F.lit("https://x.example/"), F.col("id").cast("string")))
    return base.podcast(["ai_news", "research"], "month", 12, terms=EACH, core_terms=CORE)


@query(EPISODE_TEXT + "SELECT script, seconds FROM timed", "items scores firsts")
def podcast_script(spark, d):
    return _episode(spark, d)["script"].select("script", "seconds")


@query(EPISODE_TEXT + "SELECT k AS place, duration, (30 + coalesce(sum(duration) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM dealt", "items scores firsts")
def podcast_segments(spark, d):
    return _episode(spark, d)["segments"].select(F.col("place").cast("long").alias("place"), "duration", "start")


@query(EPISODE_TEXT + """SELECT count(*) FILTER (WHERE k <= 12 AND id % 2 = 0) AS errors, count(*) FILTER (WHERE id % 2 = 1) AS warnings, CASE WHEN count(*) FILTER (WHERE id % 2 = 0) = 0 THEN 'Yes' ELSE 'No' END AS passed FROM dig""", "items scores firsts")
def podcast_report(spark, d):
    """The report of an episode with an issue for each of its digests."""
    base = corpus(spark, d)
    base.items = base.items.withColumn("url", F.concat(F.lit("https://x.example/"), F.col("id").cast("string")))

    def issues(made):
        severity = F.when(F.col("id").cast("long") % 2 == 0, "error").otherwise("warning")
        return made.select(severity.alias("severity"), F.lit("unsupported_claim").alias("type"), "one_sentence_gist", "title").select("severity", "type", F.col("one_sentence_gist").alias("line"), F.lit("no source").alias("issue"), F.col("title").alias("fix"))

    made = base.podcast(["ai_news", "research"], "month", 12, terms=EACH, core_terms=CORE, issues=issues)
    return made["report"].select("errors", "warnings", F.regexp_extract("report", r"Verification:\*\* (\w+)", 1).alias("passed"))


# -- syncs ------------------------------------------------------------------------


@query(SYNCED + "WHERE doc_id % 90 < 20")
def stream_paged_sync(spark, d):
    """Pages of 25 articles under a budget of a few calls a day: the sync stops in the
    middle, goes on the next days, and in the end has what one run has."""
    folder, table, _ = _streamed(spark)
    n = F.floor(F.col("id").cast("long") / 25).cast("int")
    rows = _articles(spark, d).withColumn(ingest.PAGE, n).withColumn(ingest.PAGES, F.floor(n / ingest.PAGES_A_FOLDER).cast("int"))
    rows.repartition(ingest.PAGES).write.partitionBy(ingest.PAGES).json(folder)
    pages, day, state = len(ingest.landed_pages(spark, folder)), 0, {"status": "paused"}
    while state["status"] == "paused":
        state = ingest.paged_sync(spark, folder, table, AS_OF + day * DAY, FOLDERS, most=2 + pages // 3, catch_up_days=20)
        day += 1
    if day < 3:
        raise ValueError("the budget did not stop the sync")
    return _sync_result(table)


@query(SYNCED)
def stream_bulk_sync(spark, d):
    """All that has landed, whatever its time."""
    folder, table, _ = _streamed(spark)
    _land(spark, d, "true", folder)
    ingest.stream_sync(spark, folder, table, FOLDERS)
    return _sync_result(table)


@query(SYNCED + "WHERE doc_id % 2 = 0")
def stream_label_sync(spark, d):
    """The articles under one label."""
    folder, table, _ = _streamed(spark)
    _land(spark, d, "true", folder)
    ingest.label_sync(spark, folder, table, FOLDERS, "Papers")
    return _sync_result(table)


@query(SYNCED + "WHERE source = 'src7'")
def stream_single_sync(spark, d):
    folder, table, _ = _streamed(spark)
    _land(spark, d, "true", folder)
    ingest.stream_sync(spark, folder, table, FOLDERS, ("src7",))
    return _sync_result(table)


# -- ratings and feeds ------------------------------------------------------------


@query("""SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 > 0 THEN doc_id % 4 END::INTEGER AS rating, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'taken back' ELSE 'first' END END AS notes,
  CASE WHEN doc_id % 3 = 0 THEN 1767225600 - doc_id % 9 END AS rated_at, doc_id % 5 = 0 AND doc_id % 10 > 0 AS starred FROM documents""")
def api_item_relevance(spark, d):
    """Ratings of a third of the items, some taken back, and stars, some of them too."""
    ratings, n = Ratings(spark, new_place(spark, "ratings")), F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id", n.alias("item_id"))
    rated = docs.where(n % 3 == 0).select("item_id", (n % 4).alias("rating"), F.lit("first").alias("notes"), (F.lit(AS_OF) - n % 9).alias("rated_at"), F.lit(0).alias("seq"))
    ratings.rate(rated)
    ratings.star(docs.where(n % 5 == 0).select("item_id", F.lit(True).alias("starred"), F.lit(0).alias("seq")))
    ratings.rate(docs.where(n % 9 == 0).select("item_id", F.lit(None).cast("int").alias("rating"), F.lit("taken back").alias("notes"), F.lit(AS_OF).alias("rated_at"), F.lit(0).alias("seq")))
    ratings.star(docs.where(n % 10 == 0).select("item_id", F.lit(False).alias("starred"), F.lit(0).alias("seq")))
    return ratings.of(docs)


FEEDS = """feeds AS (SELECT 'feed/' || s_suppkey AS stream_id, s_name AS canonical_name, CASE s_nationkey % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'community' ELSE 'newsletters' END AS default_category, 'f' || s_nationkey || '.example' AS vendor FROM supplier)"""
FOLDER_NAMES = ["Research", "Developer Communities", "Other"]


def _feeds(spark, d):
    """Suppliers as subscriptions, refreshed into a stored table twice."""
    table, n = SnapshotTable(spark, new_place(spark, "feeds"), ["stream_id"]), F.col("s_nationkey")
    label = F.element_at(F.array(*map(F.lit, FOLDER_NAMES)), (n % 3 + 1).cast("int"))
    rows = read(spark, d, "supplier").select(F.concat(F.lit("feed/"), F.col("s_suppkey").cast("string")).alias("stream_id"), F.col("s_name").alias("title"), F.concat(F.lit("https://f"), n.cast("string"), F.lit(".example/x")).alias("html_url"), F.array(label, F.lit("research")).alias("labels"))
    for part in (rows.where("s_suppkey % 2 = 0").withColumn("title", F.lit("old")), rows):
        refresh_feeds(table, part, {"research": "research", "developer communities": "community"})
    return table.read()


@query(f"WITH {FEEDS} SELECT * FROM feeds")
def api_refresh_feeds(spark, d):
    return _feeds(spark, d).select("stream_id", "canonical_name", "default_category", "vendor")


@query(f"WITH {FEEDS} SELECT stream_id, canonical_name, default_category FROM feeds ORDER BY canonical_name, stream_id")
def api_feeds(spark, d):
    return _feeds(spark, d).select("stream_id", "canonical_name", "default_category").orderBy("canonical_name", "stream_id")


@query(f"""WITH {FEEDS}, r AS (SELECT 'feed/' || s_suppkey AS stream_id, s_suppkey % 4 AS relevance FROM supplier WHERE s_suppkey % 5 > 0)
SELECT stream_id, canonical_name, coalesce(relevance, 1)::INTEGER AS relevance, (CASE coalesce(relevance, 1) WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.3 ELSE 1.6 END)::DOUBLE AS factor FROM feeds LEFT JOIN r USING (stream_id)""")
def api_source_relevance(spark, d):
    ratings, n = Ratings(spark, new_place(spark, "ratings")), F.col("s_suppkey")
    rows = read(spark, d, "supplier").where(n % 5 > 0).select(F.concat(F.lit("feed/"), n.cast("string")).alias("stream_id"), "s_suppkey")
    for seq, relevance in enumerate((F.lit(3), n % 4)):
        ratings.set_sources(rows.select("stream_id", relevance.alias("relevance"), F.lit(seq).alias("seq")))
    return ratings.source_factors(_feeds(spark, d)).select("stream_id", "canonical_name", "relevance", "factor")
