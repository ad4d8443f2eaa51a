"""Scores, ranks and selections."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import half_up, text_of
from feedloom.functions.urls import url_key
from feedloom.operators import prompt, ranking, selection
from feedloom.plans.registry import query
from feedloom.sources.items import AS_OF, items, read, scores, text_items, with_urls

#: The texts are invented prose, in which the categories' own terms don't occur: these do.
TERMS = ["the", "and", "that", "the", "que", "und"]
CORE = ("then", "shre", "onth", "inwh", "ndti", "eaux", "verz", "nter", "ster", "esor", "chge", "tion", "mente")
TOPICS = ["agent", "then", "quality", "onthe"]

BM25 = """kept AS (SELECT * FROM items WHERE published_at >= 1767225600 - 30 * 86400),
toks AS (SELECT id, category, unnest(regexp_extract_all(lower(concat_ws(' ', title, summary, source_title, category)), '[a-z0-9_]+')) AS tok FROM kept),
tk AS (SELECT * FROM toks WHERE length(tok) > 2),
len AS (SELECT k.id, k.category, count(tk.tok) AS dl FROM kept k LEFT JOIN tk ON tk.id = k.id GROUP BY 1, 2),
corp AS (SELECT category, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY 1),
q(term, times) AS (VALUES ('the', 2), ('and', 1), ('that', 1), ('que', 1), ('und', 1)),
tf AS (SELECT id, category, tok, count(*) AS f FROM tk WHERE tok IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT category, tok, count(*) AS n FROM tf GROUP BY ALL),
raw AS (SELECT l.id, l.category, coalesce(sum(q.times * ln((c.n - df.n + 0.5) / (df.n + 0.5) + 1) * tf.f * 2.5 / (tf.f + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))), 0) AS s
  FROM len l JOIN corp c USING (category) LEFT JOIN tf ON tf.id = l.id LEFT JOIN df ON df.category = l.category AND df.tok = tf.tok LEFT JOIN q ON q.term = tf.tok GROUP BY l.id, l.category),
bm AS (SELECT id, category, s, least(1.0, s / greatest(max(s) OVER (PARTITION BY category), 1.0)) AS bm25 FROM raw)"""

CFG = """cfg(category, half, wl, wb, wr, least_rel) AS (VALUES ('newsletters', 3, 0.45, 0.35, 0.2, 5), ('podcasts', 7, 0.5, 0.3, 0.2, 5), ('tech_articles', 5, 0.4, 0.4, 0.2, 5),
  ('ai_news', 2, 0.45, 0.35, 0.2, 5), ('product_news', 4, 0.45, 0.35, 0.2, 5), ('community', 3, 0.4, 0.35, 0.15, 4), ('research', 10, 0.5, 0.3, 0.2, 5))"""

BOOST = """(SELECT count(*) FROM (VALUES ('then'), ('shre'), ('onth'), ('inwh'), ('ndti'), ('eaux'), ('verz'), ('nter'), ('ster'), ('esor'), ('chge'), ('tion'), ('mente')) t(w)
  WHERE contains(lower(k.title || ' ' || k.summary), t.w))"""

RANKED = f"""WITH {BM25}, {CFG},
b AS (SELECT k.id, {BOOST} AS n FROM kept k),
mixed AS (
  SELECT k.id, k.title, k.summary, k.source_title, k.category, k.published_at, bm.bm25, f.item_id IS NOT NULL AS scored, coalesce(f.off_topic, false) AS off_topic, coalesce(f.agentic, false) AS agentic, coalesce(f.good, false) AS good,
    CASE WHEN f.item_id IS NOT NULL THEN f.relevance ELSE floor(bm.bm25 * 10 + 0.5) END AS relevance,
    CASE WHEN f.item_id IS NOT NULL THEN (0.7 * f.relevance + 0.3 * f.usefulness) / 10 ELSE bm.bm25 END AS llm,
    greatest(0.2, least(1.0, pow(2.0, -((1767225600 - k.published_at) / 86400.0) / c.half))) AS recency, c.*,
    CASE WHEN b.n >= 3 THEN 3.0 WHEN b.n = 2 THEN 2.0 WHEN b.n = 1 THEN 1.5 ELSE 1.0 END AS boost
  FROM kept k JOIN bm ON bm.id = k.id JOIN cfg c ON c.category = k.category JOIN b ON b.id = k.id LEFT JOIN firsts f ON f.item_id = k.id),
ranked AS (SELECT *, (wl::DOUBLE * llm + wb::DOUBLE * bm25 + wr::DOUBLE * recency) * boost AS final FROM mixed WHERE NOT off_topic AND relevance >= CASE WHEN scored THEN least_rel ELSE 3 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(final, 9) DESC, id) AS rank FROM ranked) """


def ranked(spark, d, columns=(), **how):
    terms = dict.fromkeys(config.CATEGORIES, TERMS)
    return ranking.rank_categories(text_items(spark, d), scores(spark, d), AS_OF, 30, terms=terms, core_terms=CORE, columns=columns, **how)


@query(f"WITH {BM25} SELECT id, category, round(s, 6) AS raw, round(bm25, 6) AS bm25 FROM bm", "items")
def bm25_score(spark, d):
    rows = text_items(spark, d).where(ranking.in_window("published_at", AS_OF, 30))
    rows = ranking.bm25(rows, dict.fromkeys(config.CATEGORIES, TERMS), text_of("title", "summary", "source_title", "category"), "category", columns=[])
    return rows.select("id", "category", F.round("bm25_raw", 6).alias("raw"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {BM25} SELECT category, count(*) AS n, round(avg(bm25), 6) AS mean, 5.0::DOUBLE AS llm, 0.5::DOUBLE AS recency, round(max(bm25), 6) AS final FROM bm GROUP BY category", "items")
def bm25_batch_score(spark, d):
    """All categories in one job, with the placeholders that a batch run writes."""
    return bm25_score(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bm25"), 6).alias("mean"), F.lit(5.0).alias("llm"), F.lit(0.5).alias("recency"), F.max("bm25").alias("final"))


@query("SELECT id, round(greatest(0.2, least(1.0, exp(-ln(2) * ((1767225600 - published_at) / 86400.0) / 7.0))), 6) AS recency FROM items", "items")
def recency_decay(spark, d):
    return items(spark, d).select("id", F.round(ranking.recency("published_at", AS_OF, 7.0), 6).alias("recency"))


@query(f"SELECT k.id, CASE WHEN b.n >= 3 THEN 3.0 WHEN b.n = 2 THEN 2.0 WHEN b.n = 1 AND contains(lower(k.summary), 'agent') THEN 1.5 WHEN b.n = 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS boost FROM items k, LATERAL (SELECT {BOOST} AS n) b", "items")
def domain_boost(spark, d):
    return text_items(spark, d).select("id", ranking.domain_boost(text_of("title", "summary"), CORE).alias("boost"))


def _values(words):
    return ", ".join(f"('{w}')" for w in words)


def _heuristic_sql():
    groups = ", ".join(f"('{tag}', '{word}')" for tag, words in config.HEURISTIC_GROUPS.items() for word in words)
    return f"""WITH g(tag, word) AS (VALUES {groups}), off(word) AS (VALUES {_values(config.OFF_TOPIC)}), t AS (SELECT id, lower(title || ' ' || summary) AS txt FROM items),
h AS (SELECT t.id, g.tag, least(count(*) * 0.5, 2) AS boost FROM t JOIN g ON contains(t.txt, g.word) GROUP BY ALL),
s AS (SELECT t.id, coalesce(sum(h.boost), 0)::DOUBLE AS b, count(h.tag) AS n, (SELECT count(*) FROM off WHERE contains(t.txt, off.word)) AS o, string_agg(h.tag, ',' ORDER BY h.tag) AS tags FROM t LEFT JOIN h ON h.id = t.id GROUP BY t.id, t.txt)
SELECT id, floor((CASE WHEN o > 0 AND n = 0 THEN 2 ELSE least(10, 5 + b) END) * 10 + 0.5) / 10 AS relevance, floor(least(10, 5 + b * 0.8) * 10 + 0.5) / 10 AS usefulness,
  CASE WHEN o > 0 AND n = 0 THEN 'off-topic' ELSE coalesce(tags, '') END AS tags FROM s"""


@query(_heuristic_sql(), "items")
def heuristic_llm_score(spark, d):
    rows = text_items(spark, d).select("id", ranking.heuristic_score(text_of("title", "summary")).alias("found"))
    return rows.select("id", "found.relevance", "found.usefulness", F.array_join(F.array_sort("found.tags"), ",").alias("tags"))


@query("SELECT item_id, scored_at, round(least(10, greatest(0, 0.7 * relevance + 0.3 * usefulness)), 6)::DOUBLE AS llm FROM scores", "scores")
def llm_composite(spark, d):
    return scores(spark, d).select("item_id", "scored_at", F.round(ranking.llm_composite("relevance", "usefulness"), 6).alias("llm"))


@query(RANKED + "SELECT category, rank, id, source_title, round(final, 6) AS final, round(bm25, 6) AS bm25, round(llm, 6) AS llm, round(recency, 6) AS recency FROM placed", "items scores firsts")
def rank_category(spark, d):
    rows = ranking.with_rank(ranked(spark, d))
    return rows.select("category", "rank", "id", "source_title", *[F.round(c, 6).alias(c) for c in ("final", "bm25", "llm", "recency")])


DIVERSE = RANKED + """, capped AS (SELECT *, (SELECT count(*) FROM placed q WHERE q.category = p.category AND q.source_title = p.source_title AND q.rank <= p.rank) AS in_source FROM placed p),
first AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank) AS position FROM capped WHERE in_source <= 2 QUALIFY position <= 10),
rest AS (SELECT p.*, (SELECT count(*) FROM first f WHERE f.category = p.category) + row_number() OVER (PARTITION BY category ORDER BY rank) AS position
  FROM capped p WHERE id NOT IN (SELECT id FROM first) QUALIFY position <= 10),
chosen AS (SELECT *, 'Selected at rank ' || position AS reason FROM first UNION ALL SELECT *, 'Selected (minimum threshold enforcement)' FROM rest) """


@query(DIVERSE + "SELECT category, position, id, source_title, reason, round(final, 6) AS final FROM chosen", "items scores firsts")
def select_diverse(spark, d):
    rows = selection.select_diverse(selection.best_of_sources(ranked(spark, d), 2, 10), per_source=2, most=10)
    return rows.select("category", "position", "id", "source_title", "reason", F.round("final", 6).alias("final"))


URL_KEY = r"""lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END"""


@query(f"WITH k AS (SELECT i.id, i.published_at, {URL_KEY} AS key FROM items i JOIN urls USING (id)) SELECT arg_min(id, -published_at * 1000000 + id) AS id, key FROM k GROUP BY key", "items urls")
def dedupe_url(spark, d):
    rows = with_urls(items(spark, d), spark, d)
    return selection.keep_first(rows, url_key("url"), [F.desc("published_at"), "id"]).select("id", url_key("url").alias("key"))


@query("WITH m AS (SELECT id, 0 AS place FROM items WHERE id % 2 = 0 UNION ALL SELECT id, 1 FROM items WHERE id % 3 = 0 UNION ALL SELECT id, 2 FROM items WHERE id % 5 = 0) SELECT id, min(place) AS place FROM m GROUP BY id", "items")
def dedupe_id(spark, d):
    rows = items(spark, d).select("id")
    parts = [rows.where(F.col("id") % n == 0).withColumn("place", F.lit(k)) for k, n in enumerate((2, 3, 5))]
    return selection.keep_first(parts[0].unionByName(parts[1]).unionByName(parts[2]), F.col("id"), ["place"])


@query("""WITH a AS (SELECT doc_id, (['day', 'week', 'month', 'all', 'year'])[doc_id % 5 + 1] AS period, (n_chars % 50 + 1)::BIGINT AS lim FROM documents),
c AS (SELECT *, CASE period WHEN 'day' THEN 1 WHEN 'week' THEN 4 WHEN 'month' THEN 5 WHEN 'all' THEN 6 END AS own FROM a)
SELECT doc_id, period, lim, CASE WHEN lim > 10 THEN (own * lim + 9) // 10 ELSE own END::BIGINT AS cap FROM c""")
def items_source_cap(spark, d):
    """The cap of a source by period and limit; a request a document."""
    period = F.element_at(F.array(*map(F.lit, ["day", "week", "month", "all", "year"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = read(spark, d, "documents").select("doc_id", period.alias("period"), (F.col("n_chars") % 50 + 1).cast("long").alias("lim"))
    return rows.withColumn("cap", selection.source_caps(F.col("period"), F.col("lim")).cast("long"))


@query(RANKED + "SELECT category, rank, id FROM placed WHERE rank <= 5", "items scores firsts")
def digest_highlights(spark, d):
    return ranking.with_rank(ranked(spark, d), most=5).select("category", "rank", "id")


ALIGN = """, tagged AS (SELECT p.*, (CASE WHEN good THEN 1 ELSE 0 END + CASE WHEN agentic THEN 1 ELSE 0 END) / 4.0 AS tm,
  (SELECT count(*) FROM (VALUES ('agent'), ('then'), ('quality'), ('onthe')) t(w) WHERE contains(lower(p.title || ' ' || p.summary), t.w)) / 4.0 AS tp FROM placed p),
aligned AS (SELECT *, least(1.0, tm) * 0.5 + least(1.0, tp) * 0.5 AS a FROM tagged),
again AS (SELECT *, final * CASE WHEN a > 0.5 THEN 4 + a * 4 WHEN a > 0.3 THEN 2.5 + a * 4 WHEN a > 0.1 THEN 1.5 + a * 5 ELSE 0.3 END AS adjusted FROM aligned) """


@query(RANKED + ALIGN + "SELECT id, category, round(adjusted, 6) AS final FROM again", "items scores firsts")
def prompt_rerank(spark, d):
    rows = ranked(spark, d, extra={"present": prompt.presence(text_of("title", "summary"), TOPICS)})
    return prompt.rerank(rows, TOPICS, present="present").select("id", "category", F.round("final", 6).alias("final"))


@query(RANKED + "SELECT id, category FROM placed p WHERE NOT contains(lower(title || ' ' || summary), 'onthe') AND NOT agentic AND NOT contains(lower(title || ' ' || summary), 'agent')", "items scores firsts")
def exclude_topics(spark, d):
    avoid = ["agent", "onthe"]
    rows = ranked(spark, d, extra={"named": prompt.names_any(text_of("title", "summary"), avoid)})
    return prompt.exclude(rows, avoid, named="named").select("id", "category")


@query(RANKED + "SELECT p.id, round(p.final * 0.7 + 0.3 * (p.id % 10) / 10.0, 6) AS final FROM placed p", "items scores firsts")
def semantic_blend(spark, d):
    return ranked(spark, d).select("id", F.round(F.col("final") * 0.7 + F.col("id") % 10 / 10.0 * 0.3, 6).alias("final"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.3 ELSE 1.6 END::DOUBLE AS factor FROM documents")
def source_multiplier(spark, d):
    table = F.create_map(*[F.lit(x) for pair in config.SOURCE_MULTIPLIER.items() for x in pair])
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.element_at(table, (F.col("doc_id") % 4).cast("int")).alias("factor"))


PIPE = RANKED + ALIGN + f""", sized AS (SELECT a.*, {URL_KEY} AS key FROM again a JOIN urls USING (id) WHERE length(summary) <= 50000 AND NOT contains(lower(title || ' ' || summary), 'esandha')),
p1 AS (SELECT *, row_number() OVER (ORDER BY round(adjusted, 9) DESC, id) AS r FROM sized),
p2 AS (SELECT * EXCLUDE r, row_number() OVER (ORDER BY r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r) AS dup FROM p1) WHERE dup = 1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY r) AS s FROM p2),
p4 AS (SELECT *, row_number() OVER (ORDER BY r) AS position FROM p3 WHERE s <= 3 QUALIFY position <= 16)
SELECT position, id, category, round(adjusted, 6) AS final, floor(adjusted * 10 + 0.5)::BIGINT AS relevance FROM p4 """


def _digest_pipeline(spark, d, limit, oversize):
    """Rank every category, drop what is too long, re-rank by topics, exclude, and select across categories."""
    text = text_of("title", "summary")
    rows = ranked(spark, d, extra={"present": prompt.presence(text, TOPICS), "named": prompt.names_any(text, ["esandha"]), "size": F.length("summary")})
    rows = prompt.exclude(prompt.rerank(rows, TOPICS, present="present"), ["esandha"], named="named")
    rows = with_urls(rows, spark, d)
    if oversize:
        rows = rows.where(F.col("size") <= oversize)
    rows = rows.withColumn("all", F.lit("all"))
    top = selection.keep_first(rows, url_key("url"), [F.round("final", 9).desc(), "id"])
    top = selection.best_of_sources(top, 3, limit, group=["all"])
    return selection.select_diverse(top, per_source=3, most=limit, group=["all"])


@query(PIPE, "items scores firsts urls")
def newsletter_pipeline(spark, d):
    rows = _digest_pipeline(spark, d, 16, 50_000)  # 20 asked for, over 1.3
    return rows.select("position", "id", "category", F.round("final", 6).alias("final"), half_up(F.col("final") * 10).cast("long").alias("relevance"))


@query(PIPE.replace("length(summary) <= 50000 AND", "").replace("position <= 16", "position <= 12"), "items scores firsts urls")
def podcast_pipeline(spark, d):
    rows = _digest_pipeline(spark, d, 12, None)
    return rows.select("position", "id", "category", F.round("final", 6).alias("final"), half_up(F.col("final") * 10).cast("long").alias("relevance"))


PROMPTS = ["Focus on code search for senior engineers. ", "A casual summary of agents, avoid research. ", "Deep technical overview of RAG for the team. ", ""]


def _profile_sql():
    pick = lambda pairs: "CASE " + " ".join(f"WHEN contains(p, '{w}') THEN '{v}'" for w, v in pairs) + " END"
    every = lambda words: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(p, '{w}') THEN '{v}' END" for w, v in words) + "], lambda x: x IS NOT NULL), ',')"
    prompts = "[" + ", ".join(f"'{p}'" for p in PROMPTS) + "]"
    return f"""WITH t AS (SELECT conv_id, turn, lower(({prompts})[turn % 4 + 1] || text) AS p FROM conversations)
SELECT conv_id, turn, {every([(t, t) for t in config.PROMPT_TOPICS])} AS focus, array_to_string(list_distinct(list_filter([{", ".join(f"CASE WHEN contains(p, '{w}') THEN '{v}' END" for w, v in config.PROMPT_AVOID)}], lambda x: x IS NOT NULL)), ',') AS avoid,
  {pick(config.PROMPT_AUDIENCE)} AS audience, {pick(config.PROMPT_INTENT)} AS intent, {every([(h, h) for h in config.PROMPT_HINTS])} AS hints, {pick(config.PROMPT_VOICE)} AS voice FROM t WHERE trim(p) <> ''"""


@query(_profile_sql())
def prompt_profile(spark, d):
    """What the turns of conversations ask for, after prompts with words that profiles know."""
    said = F.concat(F.element_at(F.array(*map(F.lit, PROMPTS)), (F.col("turn") % 4 + 1).cast("int")), "text")
    found = prompt.profile_columns(said)
    rows = read(spark, d, "conversations").where(F.trim(said) != "").select("conv_id", "turn", *[c.alias(n) for n, c in found.items()])
    return rows.select("conv_id", "turn", F.array_join("focus_topics", ",").alias("focus"), F.array_join(F.array_distinct("exclude_topics"), ",").alias("avoid"), "audience", "intent", F.array_join("format_hints", ",").alias("hints"), F.col("voice_style").alias("voice"))
