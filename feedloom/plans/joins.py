"""Joins."""
from __future__ import annotations


from pyspark.sql import functions as F


from feedloom.operators.ranking import first_scores, latest_scores
from feedloom.operators.search import dot
from feedloom.plans.registry import query
from feedloom.sources.items import feed_config, items, query_vector, read, scores, vectors, with_urls


@query("SELECT i.id, i.title, s.relevance FROM scores s JOIN items i ON s.item_id = i.id ORDER BY s.relevance DESC, i.id, s.scored_at LIMIT 10", "items scores")
def join_inner_scores_items(spark, d):
    rows = scores(spark, d).join(items(spark, d), F.col("item_id") == F.col("id"))
    return rows.orderBy(F.desc("relevance"), "id", "scored_at").limit(10).select("id", "title", "relevance")


@query("SELECT l.l_orderkey, p.p_partkey, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_suppkey = 7")
def join_inner_junction(spark, d):
    junction = read(spark, d, "lineitem").where("l_suppkey = 7").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return junction.join(read(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "p_partkey", "p_brand")


@query("""SELECT p.page_id AS starred_id, i.title, coalesce(i.published_at, 0) AS published_at FROM (SELECT page_id, page_id * 9 AS item_id FROM pages) p LEFT JOIN items i ON i.id = p.item_id""", "items")
def join_left_starred(spark, d):
    starred = read(spark, d, "pages").select(F.col("page_id").alias("starred_id"), (F.col("page_id") * 9).alias("id"))
    return starred.join(items(spark, d), "id", "left").select("starred_id", "title", F.coalesce("published_at", F.lit(0)).alias("published_at"))


@query("SELECT i.id, f.relevance, f.usefulness FROM items i LEFT JOIN firsts f ON f.item_id = i.id", "items scores firsts")
def join_left_oldest_score(spark, d):
    first = first_scores(scores(spark, d)).select(F.col("item_id").alias("id"), "relevance", "usefulness")
    return items(spark, d).select("id").join(first, "id", "left")


@query("SELECT i.id, f.relevance, f.scored_at FROM items i LEFT JOIN lasts f ON f.item_id = i.id", "items scores lasts")
def join_latest_score(spark, d):
    last = latest_scores(scores(spark, d)).select(F.col("item_id").alias("id"), "relevance", "scored_at")
    return items(spark, d).select("id").join(last, "id", "left")


@query("""WITH feeds AS (SELECT 'src' || n AS stream_id, 'Feed ' || n AS canonical_name,
  (['newsletters', 'podcasts', 'tech_articles', 'ai_news', 'product_news', 'community', 'research'])[n % 7 + 1] AS default_category FROM range(0, 20, 2) t(n))
SELECT i.id, coalesce(f.canonical_name, 'Unknown') AS source_name, coalesce(f.default_category, 'tech_articles') AS category
FROM items i LEFT JOIN feeds f ON f.stream_id = i.source_title""", "items")
def join_left_feed_config(spark, d):
    feeds = feed_config(spark).withColumnRenamed("stream_id", "source_title")  # ten rows
    rows = items(spark, d).select("id", "source_title").join(F.broadcast(feeds), "source_title", "left")
    return rows.select("id", F.coalesce("canonical_name", F.lit("Unknown")).alias("source_name"), F.coalesce("default_category", F.lit("tech_articles")).alias("category"))


@query("SELECT id, title FROM items WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 1)", "items")
def join_semi_candidates(spark, d):
    wanted = read(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"))
    return items(spark, d).join(wanted, "id", "left_semi").select("id", "title")


@query("SELECT e.vec_id AS id, i.title, e.label FROM embeddings e, items i WHERE i.id = e.vec_id AND e.label = 2", "items")
def join_lookup_by_id(spark, d):
    scored = read(spark, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("id"), "label")
    return scored.join(items(spark, d), "id").select("id", "title", "label")


@query("SELECT id FROM items EXCEPT SELECT vec_id FROM embeddings", "items")
def join_anti_missing_embeddings(spark, d):
    return items(spark, d).select("id").join(vectors(spark, d).select(F.col("item_id").alias("id")), "id", "left_anti")


@query("SELECT i.id, i.id IN (SELECT vec_id FROM embeddings) AS present FROM items i", "items")
def join_exists_map(spark, d):
    have = vectors(spark, d).select(F.col("item_id").alias("id"), F.lit(True).alias("have"))
    return items(spark, d).select("id").join(have, "id", "left").select("id", F.col("have").isNotNull().alias("present"))


@query("""SELECT e.vec_id AS item_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS product
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q""")
def join_cross_query_vector(spark, d):
    one = query_vector(spark, d, 3)  # one row
    return vectors(spark, d).crossJoin(F.broadcast(one)).select("item_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("product"))


@query("""WITH digests AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) SELECT u.id, g.page_id FROM urls u LEFT JOIN digests g ON g.url = u.url""", "urls")
def join_url_digest(spark, d):
    digests = read(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("digest"))
    rows = with_urls(items(spark, d).select("id"), spark, d)
    return rows.join(digests, "url", "left").select("id", F.col("digest").alias("page_id"))


@query("""SELECT c.conv_id, c.turn, d.doc_id FROM conversations c JOIN documents d ON d.doc_id = c.conv_id * 8 + c.turn WHERE c.role = 'user'""")
def join_positional(spark, d):
    """Position in a list meets the row of that number: a conversation's turn k is item conv * 8 + k."""
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))  # a conversation has few turns
    flat = turns.select("conv_id", F.explode("turns").alias("t")).where("t.role = 'user'")
    flat = flat.select("conv_id", F.col("t.turn").alias("turn"), (F.col("conv_id") * 8 + F.col("t.turn")).alias("doc_id"))
    return flat.join(read(spark, d, "documents").select("doc_id"), "doc_id").select("conv_id", "turn", "doc_id")
