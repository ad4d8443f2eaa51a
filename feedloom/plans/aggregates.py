"""Aggregations and distributions."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import tokens
from feedloom.operators import analytics, ranking
from feedloom.plans.registry import query
from feedloom.sources.items import AS_OF, DAY, items, read, scores, text_items

# documents as a full-text cache: some were fetched, some failed, some were never tried
def have():
    return F.col("id") % 5 < 3


def failed():
    return F.col("id") % 5 == 3


def _scored(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", ((F.col("n_chars") % 1000) / 1000.0).alias("final"), F.col("n_chars").cast("double").alias("length"))


SCORED = "WITH scored AS (SELECT doc_id AS id, source, lang, n_chars % 1000 / 1000.0::DOUBLE AS final, n_chars::DOUBLE AS length FROM documents) "


@query("SELECT count(*) AS total, count(*) FILTER (WHERE category = 'research') AS research FROM items", "items")
def agg_count(spark, d):
    return items(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("category") == "research").alias("research"))


@query("SELECT max(published_at) AS high_water FROM items", "items")
def agg_max_published(spark, d):
    return items(spark, d).agg(F.max("published_at").alias("high_water"))


@query("SELECT category, count(*) AS n FROM items GROUP BY category ORDER BY n DESC, category LIMIT 5", "items")
def agg_group_count(spark, d):
    return items(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(5)


@query("""SELECT coalesce(avg(relevance), 0) AS relevance, coalesce(avg(usefulness), 0) AS usefulness, count(s.item_id) AS n
FROM scores s JOIN items i ON i.id = s.item_id WHERE i.category = 'research'""", "items scores")
def agg_avg_scores(spark, d):
    one = items(spark, d).where("category = 'research'").select("id")
    rows = scores(spark, d).join(one, F.col("item_id") == F.col("id"))
    return rows.agg(F.coalesce(F.avg("relevance"), F.lit(0.0)).alias("relevance"), F.coalesce(F.avg("usefulness"), F.lit(0.0)).alias("usefulness"), F.count("item_id").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT item_id) AS items, count(DISTINCT usefulness) AS levels, avg(relevance) AS mean, max(relevance) AS high, min(relevance) AS low FROM scores", "scores")
def agg_distinct_stats(spark, d):
    return scores(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"), F.count_distinct("usefulness").alias("levels"),
                                F.avg("relevance").alias("mean"), F.max("relevance").alias("high"), F.min("relevance").alias("low"))


@query("SELECT i.category, count(*) AS n, avg(s.relevance) AS mean, max(s.relevance) AS high FROM scores s JOIN items i ON i.id = s.item_id GROUP BY 1", "items scores")
def agg_score_by_category(spark, d):
    rows = scores(spark, d).join(items(spark, d).select("id", "category"), F.col("item_id") == F.col("id"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("relevance").alias("mean"), F.max("relevance").alias("high"))


@query("""SELECT category, count(*) AS total, sum(CASE WHEN id % 5 < 3 THEN 1 ELSE 0 END)::BIGINT AS cached, sum(CASE WHEN id % 5 = 3 THEN 1 ELSE 0 END)::BIGINT AS errors,
  sum(CASE WHEN id % 5 = 4 THEN 1 ELSE 0 END)::BIGINT AS never, round(100.0 * sum(CASE WHEN id % 5 < 3 THEN 1 ELSE 0 END) / count(*), 1) AS pct FROM items GROUP BY category""", "items")
def agg_conditional_coverage(spark, d):
    return analytics.coverage(items(spark, d), have(), failed(), ["category"])


@query("""SELECT source_title, count(*) AS total, count(*) FILTER (WHERE id % 5 < 3) AS cached, count(*) FILTER (WHERE id % 5 = 3) AS errors, count(*) FILTER (WHERE id % 5 = 4) AS never,
  round(100.0 * count(*) FILTER (WHERE id % 5 < 3) / count(*), 1) AS pct FROM items WHERE category = 'research' GROUP BY 1 ORDER BY never DESC, source_title LIMIT 5""", "items")
def agg_coverage_by_source(spark, d):
    rows = analytics.coverage(items(spark, d).where("category = 'research'"), have(), failed(), ["source_title"])
    return rows.orderBy(F.desc("never"), "source_title").limit(5)


#: The first name that an url contains decides; made hosts stand for those of feeds.
KINDS = (("hacker", "Hacker News"), ("reddit", "Reddit"), ("economist", "Economist (paywall)"), ("wsj", "WSJ (paywall)"), ("github", "GitHub"), ("medium", "Medium"), ("substack", "Substack"), ("arxiv", "arXiv"))


@query("""WITH m AS (SELECT page_id, url || (['', '/hacker', '/reddit', '/economist', '/wsj', '/github', '/medium', '/substack', '/arxiv', '/arxiv/github'])[page_id % 10 + 1] AS url FROM pages),
b AS (SELECT CASE WHEN url LIKE '%hacker%' THEN 'Hacker News' WHEN url LIKE '%reddit%' THEN 'Reddit' WHEN url LIKE '%economist%' THEN 'Economist (paywall)' WHEN url LIKE '%wsj%' THEN 'WSJ (paywall)' WHEN url LIKE '%github%' THEN 'GitHub'
  WHEN url LIKE '%medium%' THEN 'Medium' WHEN url LIKE '%substack%' THEN 'Substack' WHEN url LIKE '%arxiv%' THEN 'arXiv' ELSE 'Other' END AS kind, page_id % 4 = 0 AS error FROM m)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE error) AS errors FROM b GROUP BY kind""")
def agg_case_bucket(spark, d):
    rows = read(spark, d, "pages").select("page_id", F.concat("url", F.element_at(F.array(*map(F.lit, ("", "/hacker", "/reddit", "/economist", "/wsj", "/github", "/medium", "/substack", "/arxiv", "/arxiv/github"))), (F.col("page_id") % 10 + 1).cast("int"))).alias("url"))
    kind = analytics.first_bucket("url", KINDS, "Other")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("page_id") % 4 == 0).alias("errors"))


@query("""SELECT 'ALL' AS category, count(*) AS total, count(*) FILTER (WHERE id % 5 < 3) AS cached, sum(length(summary)) / 1024.0 / 1024.0 AS mb FROM items
UNION ALL SELECT category, count(*), count(*) FILTER (WHERE id % 5 < 3), sum(length(summary)) / 1024.0 / 1024.0 FROM items GROUP BY category""", "items")
def agg_rollup_union(spark, d):
    """The overall row and the categories' rows in one pass."""
    rows = items(spark, d).rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(have()).alias("cached"), (F.sum(F.length("summary")) / 1024.0 / 1024.0).alias("mb"), F.grouping("category").alias("g"))
    return rows.select(F.when(F.col("g") == 1, F.lit("ALL")).otherwise(F.col("category")).alias("category"), "total", "cached", "mb")


@query("""SELECT 'items' AS metric, count(*)::DOUBLE AS value FROM items UNION ALL SELECT 'sources', count(DISTINCT source_title)::DOUBLE FROM items
UNION ALL SELECT 'cached', count(*)::DOUBLE FROM items WHERE id % 5 < 3 UNION ALL SELECT 'chars', sum(length(summary))::DOUBLE FROM items""", "items")
def agg_metric_pivot_long(spark, d):
    one = items(spark, d).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source_title").alias("sources"), F.count_if(have()).alias("cached"), F.sum(F.length("summary")).alias("chars"))
    return analytics.long_form(one, ["items", "sources", "cached", "chars"])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE title IS NULL OR title = '') AS no_title, count(*) FILTER (WHERE summary IS NULL OR summary = '') AS no_summary FROM items", "items")
def agg_quality_nulls(spark, d):
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    return items(spark, d).agg(F.count(F.lit(1)).alias("total"), empty("title").alias("no_title"), empty("summary").alias("no_summary"))


@query("SELECT avg(length(text)) AS mean, min(length(text)) AS low, max(length(text)) AS high FROM documents")
def agg_length_stats(spark, d):
    n = F.length("text")
    return read(spark, d, "documents").agg(F.avg(n).alias("mean"), F.min(n).cast("long").alias("low"), F.max(n).cast("long").alias("high"))


@query("SELECT min(published_at) AS first, max(published_at) AS last, count(published_at) AS n FROM items", "items")
def agg_date_span(spark, d):
    return items(spark, d).agg(F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count("published_at").alias("n"))


@query(SCORED + """, ends AS (SELECT min(length) AS lo, max(length) AS hi FROM scored)
SELECT b::INTEGER AS bucket, lo + (hi - lo) * b / 10 AS low, (SELECT count(*) FROM scored WHERE CASE WHEN b = 9 THEN length >= lo + (hi - lo) * 0.9 ELSE floor((length - lo) / (hi - lo) * 10) = b END) AS n
FROM ends, range(10) t(b)""")
def agg_histogram(spark, d):
    return analytics.histogram(_scored(spark, d), "length", 10)


@query(SCORED + """, placed AS (SELECT lang, final, row_number() OVER (PARTITION BY lang ORDER BY final) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM scored)
SELECT lang, final AS median FROM placed WHERE k = n // 2""")
def agg_upper_median(spark, d):
    return analytics.upper_median(_scored(spark, d), "final", ["lang"])


@query(SCORED + """SELECT 'final' AS metric, count(final) AS n, min(final) AS low, max(final) AS high, avg(final) AS mean FROM scored
UNION ALL SELECT 'length', count(length), min(length), max(length), avg(length) FROM scored""")
def agg_distribution(spark, d):
    return analytics.distribution(_scored(spark, d), ["final", "length"])


@query(SCORED + "SELECT source, count(*) AS n, round(avg(final), 6) AS mean, max(final) AS high, min(final) AS low FROM scored GROUP BY source ORDER BY round(avg(final), 9) DESC, source LIMIT 10")
def agg_top_sources(spark, d):
    rows = _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("final").alias("m"), F.max("final").alias("high"), F.min("final").alias("low"))
    return rows.orderBy(F.round("m", 9).desc(), "source").limit(10).select("source", "n", F.round("m", 6).alias("mean"), "high", "low")


@query(SCORED + "SELECT min(final) AS low, max(final) AS high, round(avg(final), 6) AS mean FROM (SELECT final FROM scored ORDER BY final DESC, id LIMIT 20)")
def agg_score_range(spark, d):
    top = _scored(spark, d).orderBy(F.desc("final"), "id").limit(20)
    return top.agg(F.min("final").alias("low"), F.max("final").alias("high"), F.round(F.avg("final"), 6).alias("mean"))


@query("""WITH r AS (SELECT CASE WHEN id % 4 = 0 THEN 'Selected (score ' || id || ')' WHEN id % 4 = 1 THEN 'Selected' ELSE 'Source cap reached (' || source_title || ')' END AS reason FROM items)
SELECT string_split(reason, ' (')[1] AS kind, starts_with(reason, 'Selected') AS selected, count(*) AS n FROM r GROUP BY ALL""", "items")
def agg_selection_reasons(spark, d):
    reason = (F.when(F.col("id") % 4 == 0, F.concat(F.lit("Selected (score "), F.col("id").cast("string"), F.lit(")"))).when(F.col("id") % 4 == 1, "Selected")
              .otherwise(F.concat(F.lit("Source cap reached ("), "source_title", F.lit(")"))))
    rows = items(spark, d).withColumn("reason", reason)
    return rows.groupBy(F.get(F.split("reason", r" \("), F.lit(0)).alias("kind"), F.col("reason").startswith("Selected").alias("selected")).agg(F.count(F.lit(1)).alias("n"))


WEIGHTS = {"the": 1.0, "und": 2.0, "tion": 1.5, "zu": 0.5, "que": 3.0}
THEMES = """WITH t AS (SELECT i.id, lower(i.title || ' ' || i.summary) AS txt, coalesce(f.good, false) AS good, coalesce(f.off_topic, false) AS off, coalesce(f.agentic, false) AS ag
  FROM items i LEFT JOIN firsts f ON f.item_id = i.id), found AS (
  SELECT w.theme, w.weight FROM t, (VALUES ('the', 1.0), ('und', 2.0), ('tion', 1.5), ('zu', 0.5), ('que', 3.0)) w(theme, weight) WHERE contains(t.txt, w.theme)
  UNION ALL SELECT 'quality', 1.0 FROM t WHERE good UNION ALL SELECT 'off-topic', 1.0 FROM t WHERE off UNION ALL SELECT 'agent', 1.0 FROM t WHERE ag) """


def _themed(spark, d):
    from feedloom.operators.ranking import first_scores

    first = first_scores(scores(spark, d)).select(F.col("item_id").alias("id"), "tags")
    return text_items(spark, d).join(first, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


@query(THEMES + "SELECT theme, sum(weight)::DOUBLE * CASE WHEN theme = 'que' OR theme = 'agent' THEN 2.5 ELSE 1 END AS weight FROM found GROUP BY theme", "items scores firsts")
def agg_theme_weighted(spark, d):
    from feedloom.functions.text import text_of

    return analytics.themes(_themed(spark, d), text_of("title", "summary"), F.col("tags"), WEIGHTS, ["quest", "agents"])


@query(THEMES + "SELECT theme, count(*)::DOUBLE AS weight FROM found GROUP BY theme ORDER BY weight DESC, theme LIMIT 3", "items scores firsts")
def agg_theme_count(spark, d):
    from feedloom.functions.text import text_of

    rows = analytics.themes(_themed(spark, d), text_of("title", "summary"), F.col("tags"), dict.fromkeys(WEIGHTS, 1.0))
    return rows.orderBy(F.desc("weight"), "theme").limit(3)


@query("""WITH g AS (SELECT 'quality' AS theme FROM firsts WHERE good UNION ALL SELECT 'off-topic' FROM firsts WHERE off_topic UNION ALL SELECT 'agent' FROM firsts WHERE agentic)
SELECT theme, count(*)::DOUBLE AS weight FROM g GROUP BY theme ORDER BY weight DESC, theme LIMIT 5""", "scores firsts")
def agg_theme_tag_freq(spark, d):
    rows = analytics.themes(_themed(spark, d), F.lit(""), F.col("tags"), {"\x00": 0.0})
    return rows.orderBy(F.desc("weight"), "theme").limit(5)


@query("""WITH g AS (SELECT item_id, 'quality' AS theme, usefulness FROM firsts WHERE good UNION ALL SELECT item_id, 'off-topic', usefulness FROM firsts WHERE off_topic
  UNION ALL SELECT item_id, 'agent', usefulness FROM firsts WHERE agentic)
SELECT theme, avg(usefulness) * count(*) AS score, count(*) AS n FROM g GROUP BY theme ORDER BY score DESC LIMIT 8""", "scores firsts")
def agg_theme_score(spark, d):
    from feedloom.operators.ranking import first_scores

    rows = first_scores(scores(spark, d)).select(F.explode("tags").alias("theme"), "usefulness")
    return rows.groupBy("theme").agg(F.sum("usefulness").alias("score"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), "theme").limit(8)


@query(SCORED + "SELECT source, max(final) AS best FROM scored GROUP BY source ORDER BY best DESC, source LIMIT 3")
def agg_max_by_source(spark, d):
    return _scored(spark, d).groupBy("source").agg(F.max("final").alias("best")).orderBy(F.desc("best"), "source").limit(3)


@query("""WITH p AS (SELECT category, list_position(['research', 'tech_articles', 'product_news', 'ai_news', 'community', 'newsletters', 'podcasts'], category) AS place, id, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS k FROM items)
SELECT place::INTEGER AS place, category, k AS position, id FROM p""", "items")
def agg_group_ordered_category(spark, d):
    """All entries of a digest: the place of the section, and the entry's place there,
    newest first.  An entry is a row, so no section is held in one."""
    place = F.create_map(*[x for k, c in enumerate(config.DIGEST_ORDER) for x in (F.lit(c), F.lit(k + 1))])
    rows = ranking.with_rank(items(spark, d).select("id", "category", "published_at"), "published_at", out="position", spread=4)
    return rows.select(F.coalesce(F.element_at(place, F.col("category")), F.lit(99)).alias("place"), "category", "position", "id")


@query("""WITH m AS (SELECT doc_id AS key, 1767225600 + (doc_id % 7 - 3) * 200 AS expires_at, n_chars AS count FROM documents)
SELECT CASE WHEN expires_at <= 1767225600 THEN 'expired' WHEN expires_at - 1767225600 < 300 THEN 'expiring-soon' ELSE 'valid' END AS status, count(*) AS n, sum(count)::BIGINT AS entries FROM m GROUP BY 1""")
def agg_cache_status(spark, d):
    left = (F.col("doc_id") % 7 - 3) * 200
    status = F.when(left <= 0, "expired").when(left < 300, "expiring-soon").otherwise("valid")
    return read(spark, d, "documents").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("entries"))


@query("""WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY 1)
SELECT day, used, greatest(0, 400 - used) AS remaining, round(used / 4.0, 1) AS pct, CASE WHEN used >= 400 THEN 'exhausted' WHEN used >= 320 THEN 'low' ELSE 'ok' END AS level FROM u""")
def agg_budget(spark, d):
    used = read(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("used"))
    u = F.col("used")
    return used.select("day", "used", F.greatest(F.lit(0), 400 - u).alias("remaining"), F.round(u / 4.0, 1).alias("pct"), F.when(u >= 400, "exhausted").when(u >= 320, "low").otherwise("ok").alias("level"))


@query("""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', title, summary, source_title, category)), '[a-z0-9_]+')) AS tok FROM items),
k AS (SELECT * FROM t WHERE length(tok) > 2), n AS (SELECT (SELECT count(*) FROM items) AS docs, (SELECT count(*) FROM k) AS words)
SELECT w.term, n.docs, n.words, n.words / n.docs AS avgdl, (SELECT count(DISTINCT id) FROM k WHERE tok = w.term) AS df FROM n, (VALUES ('the'), ('und'), ('that'), ('with')) w(term)""", "items")
def agg_bm25_corpus(spark, d):
    """Statistics of a corpus for a few terms in one pass, without a row for each token."""
    from feedloom.functions.text import text_of

    terms = ["the", "und", "that", "with"]
    rows = text_items(spark, d).select(tokens(text_of("title", "summary", "source_title", "category")).alias("t"))
    one = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("t")).alias("words"), *[F.count_if(F.array_contains("t", t)).alias(f"df_{t}") for t in terms])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df_{t}").alias("df")) for t in terms]))
    return one.select(pairs.alias("p"), "docs", "words").select("p.term", "docs", "words", (F.col("words") / F.col("docs")).alias("avgdl"), "p.df")


# -- further shapes on the events table: windows of time (an extension) ------------


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""")
def ext_tumbling_window(spark, d):
    rows = read(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session_window(spark, d):
    rows = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("""SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def ext_local_supplier_revenue(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read(spark, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    rows = rows.join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
