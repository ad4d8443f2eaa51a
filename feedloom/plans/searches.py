"""Search, vectors and retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.operators import ranking, search
from feedloom.plans.ranked import CORE, RANKED, TERMS
from feedloom.plans.registry import query
from feedloom.sources.items import AS_OF, items, query_vector, read, scores, text_items, vectors

PHRASE = "the then an"

KEY = """WITH t AS (SELECT id, lower(title) AS ti, lower(title || ' ' || summary) AS tx FROM items),
w(term, pat) AS (VALUES ('the', 'the'), ('then', 'then'), ('an', 'an')),
c AS (SELECT t.id, ti, len(regexp_extract_all(ti, '\\b' || pat || '\\b')) AS tw, len(regexp_extract_all(ti, pat)) AS ta, len(regexp_extract_all(tx, '\\b' || pat || '\\b')) AS xw, len(regexp_extract_all(tx, pat)) AS xa FROM t, w),
s AS (SELECT id, CASE WHEN contains(any_value(ti), 'the then an') THEN 100 ELSE 0 END + sum(tw * 30 + (ta - tw) * 10 + (xw - tw) * 5 + least(xa - (xw - tw) - tw - (ta - tw), 10) * 2) AS score FROM c GROUP BY id),
kw AS (SELECT id, score::BIGINT AS score, least(1.0, floor(score / 100 * 1000 + 0.5) / 1000)::DOUBLE AS similarity FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 100) """


@query(KEY + "SELECT * FROM kw ORDER BY score DESC, id LIMIT 40", "items")
def search_keyword(spark, d):
    return search.search_keyword(text_items(spark, d), PHRASE, 40).select("id", F.col("score").cast("long").alias("score"), "similarity")


@query("""WITH t AS (SELECT id, lower(title) AS ti, lower(title || ' ' || summary) AS tx FROM items), w(term) AS (VALUES ('the'), ('then')),
s AS (SELECT id, sum((length(ti) - length(replace(ti, term, ''))) // length(term) * 3 + least((length(tx) - length(replace(tx, term, ''))) // length(term), 10)) AS score FROM t, w GROUP BY id)
SELECT id, score::BIGINT AS score, (floor(score / 100 * 1000 + 0.5) / 1000)::DOUBLE AS similarity FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 30""", "items")
def search_term(spark, d):
    return search.search_term(text_items(spark, d), PHRASE, 30).select("id", F.col("score").cast("long").alias("score"), "similarity")


COS = """cos AS (SELECT e.vec_id AS id, CASE WHEN list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) = 0 THEN 0 ELSE list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
  / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) END AS c
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


@query(f"WITH {COS} SELECT id AS item_id, round(c, 6) AS cosine FROM cos")
def vec_cosine(spark, d):
    rows = search.with_cosine(vectors(spark, d), query_vector(spark, d))
    return rows.select("item_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {COS} SELECT id AS item_id, round(c, 6) AS cosine FROM cos ORDER BY round(c, 9) DESC, id LIMIT 10")
def vec_topk(spark, d):
    rows = search.topk(search.with_cosine(vectors(spark, d), query_vector(spark, d)), "cosine", 10, ["item_id"])
    return rows.select("item_id", F.round("cosine", 6).alias("cosine"))


@query("""SELECT vec_id AS item_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / nullif(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 0), 6) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings""")
def vec_normalize(spark, d):
    unit = search.unit(F.col("embedding"))
    rows = vectors(spark, d).select("item_id", unit.alias("u"))
    return rows.select("item_id", F.round(search.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query(f"WITH {COS} SELECT i.id, i.title, floor(c * 1000 + 0.5) / 1000 AS similarity FROM cos JOIN items i USING (id) ORDER BY round(c, 9) DESC, id LIMIT 20", "items")
def search_semantic(spark, d):
    rows = search.search_semantic(text_items(spark, d), vectors(spark, d), PHRASE, query_vector(spark, d), 20)
    return rows.select("id", "title", "similarity")


@query("""WITH t AS (SELECT id, lower(title) AS ti, lower(title || ' ' || summary) AS tx FROM items), w(term) AS (VALUES ('the'), ('then')),
s AS (SELECT id, sum((length(ti) - length(replace(ti, term, ''))) // length(term) * 3 + least((length(tx) - length(replace(tx, term, ''))) // length(term), 10)) AS score FROM t, w GROUP BY id)
SELECT id, (floor(score / 100 * 1000 + 0.5) / 1000)::DOUBLE AS similarity FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 4""", "items")
def search_semantic_fallback(spark, d):
    """A limit under five always falls back to terms."""
    return search.search_semantic(text_items(spark, d), vectors(spark, d), PHRASE, query_vector(spark, d), 4).select("id", "similarity")


@query(KEY + f", {COS} SELECT kw.id, round(0.6 * greatest(0, coalesce(cos.c, 0)) + 0.4 * least(1, similarity), 6)::DOUBLE AS similarity FROM kw LEFT JOIN cos USING (id) ORDER BY round(0.6 * greatest(0, coalesce(cos.c, 0)) + 0.4 * least(1, similarity), 9) DESC, id LIMIT 25", "items")
def search_hybrid(spark, d):
    rows = search.search_hybrid(text_items(spark, d), vectors(spark, d), PHRASE, query_vector(spark, d), 25)
    return rows.select("id", F.round("similarity", 6).alias("similarity"))


@query(KEY + "SELECT i.category, count(*) AS n, max(kw.score) AS best FROM kw JOIN items i USING (id) GROUP BY i.category", "items")
def search_all_categories(spark, d):
    rows = search.search_keyword(text_items(spark, d).where(F.col("category").isin(list(config.CATEGORIES))), PHRASE, 100)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("score").cast("long").alias("best"))


RETRIEVE = RANKED.replace("WITH kept AS (SELECT * FROM items WHERE", f"WITH {COS}, near AS (SELECT * FROM cos WHERE id IN (SELECT id FROM items) ORDER BY round(c, 9) DESC, id LIMIT 200), kept AS (SELECT * REPLACE ('newsletters' AS category) FROM items WHERE id IN (SELECT id FROM near) AND")


@query(RETRIEVE + "SELECT p.id, round(0.7 * final + 0.3 * n.c, 6) AS final FROM placed p JOIN near n USING (id) ORDER BY round(0.7 * final + 0.3 * n.c, 9) DESC, id LIMIT 100", "items scores firsts")
def retrieve_context(spark, d):
    """The nearest items, ranked among themselves under one category's settings, blended with their cosine."""
    rows = text_items(spark, d)
    near = rows.join(F.broadcast(search.nearest(rows, vectors(spark, d), query_vector(spark, d), search.retrieval_size(100))), "id")  # 200 rows at most
    best = ranking.rank_categories(near.withColumn("category", F.lit("newsletters")), scores(spark, d), AS_OF, 30, ["newsletters"], {"newsletters": TERMS}, CORE, columns=["cosine"])
    best = best.withColumn("final", F.col("final") * 0.7 + F.col("cosine") * 0.3)
    return search.topk(best, "final", 100, ["id"]).select("id", F.round("final", 6).alias("final"))


@query("""WITH c AS (SELECT doc_id, text, list_reduce(list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT), lambda h, u: CASE WHEN u < 65536 THEN (31 * h + u) % 4294967296
  ELSE (31 * ((31 * h + 55296 + (u - 65536) // 1024) % 4294967296) + 56320 + (u - 65536) % 1024) % 4294967296 END, 0::BIGINT) AS h FROM documents WHERE text <> ''),
a AS (SELECT doc_id, text, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS hash FROM c UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text = '')
SELECT doc_id, hash, 768 AS size, CASE WHEN trim(text) = '' THEN 0 ELSE round(sin(hash + 73)::FLOAT::DOUBLE, 4) END AS second FROM a""")
def embed_pseudo(spark, d):
    rows = read(spark, d, "documents").select("doc_id", search.pseudo_hash(F.col("text")).alias("hash"), search.pseudo_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", "hash", F.size("v").alias("size"), F.round(F.get("v", F.lit(1)).cast("double"), 4).alias("second"))


@query("SELECT id, length(title || ' ' || summary || ' ' || substr(summary, 1, 2000))::INTEGER AS search_chars, least(1000, length(title || ' ' || summary))::INTEGER AS retrieval_chars FROM items", "items")
def embed_text_spec(spark, d):
    search_text = F.concat_ws(" ", "title", "summary", F.substring("summary", 1, 2000))
    return items(spark, d).select("id", F.length(search_text).alias("search_chars"), F.length(F.substring(F.concat_ws(" ", "title", "summary"), 1, 1000)).alias("retrieval_chars"))
