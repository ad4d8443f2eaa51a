"""Landed replies of other services, read with explicit schemas: starred articles,
subscriptions, tags, papers, libraries and pages.  Nothing is fetched here."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import col, html_to_text
from feedloom.sources.items import FEED_ARTICLE

STARRED = f"items array<{FEED_ARTICLE.simpleString()}>, continuation string"
SUBSCRIPTIONS = "subscriptions array<struct<id:string,title:string,url:string,htmlUrl:string,categories:array<struct<id:string,label:string>>>>"
TAGS = "tags array<struct<id:string,sortid:string>>"
PAPERS = "response struct<docs:array<struct<bibcode:string,title:array<string>,author:array<string>,pubdate:string,abstract:string,body:array<string>>>>"
LIBRARY = "library_id string, documents array<string>"


def replies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed replies: a JSON object a line, a page of a list each."""
    return spark.read.schema(schema).json(path)


def starred(pages: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each starred article of the pages; `most` limits how many."""
    a = pages.select(F.explode("items").alias("a")).select("a.*")
    rows = a.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(Untitled)")).alias("title"), F.coalesce("origin.title", F.lit("Unknown Source")).alias("source_title"),
        F.coalesce(F.get("alternate.href", F.lit(0)), F.get("canonical.href", F.lit(0)), F.lit("#")).alias("url"),
        F.coalesce(F.nullif("published", F.lit(0)), F.nullif("updated", F.lit(0))).alias("published_at"), F.col("summary.content").alias("summary"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )
    return rows if most is None else rows.limit(most)


def subscriptions(pages: DataFrame) -> DataFrame:
    """(stream_id, title, url, html_url, labels) of each subscription."""
    s = pages.select(F.explode("subscriptions").alias("s")).select("s.*")
    return s.select(F.col("id").alias("stream_id"), "title", "url", F.col("htmlUrl").alias("html_url"), F.coalesce("categories.label", F.array().cast("array<string>")).alias("labels"))


def tags(pages: DataFrame) -> DataFrame:
    """(tag_id, label) of each tag; the label is the id's last part."""
    return pages.select(F.explode("tags").alias("t")).select(F.col("t.id").alias("tag_id"), F.element_at(F.split("t.id", "/"), -1).alias("label"))


def papers(pages: DataFrame) -> DataFrame:
    """(bibcode, title, authors, pubdate, abstract, body) of each paper; one row a bibcode."""
    p = pages.select(F.explode("response.docs").alias("p")).select("p.*")
    return p.select("bibcode", F.get("title", F.lit(0)).alias("title"), F.to_json("author").alias("authors"), "pubdate", "abstract", F.get("body", F.lit(0)).alias("body")).dropDuplicates(["bibcode"])


def library_items(pages: DataFrame, start: int = 0, rows: int | None = None) -> DataFrame:
    """(library_id, position, bibcode) of each library's papers, from `start` on."""
    found = pages.select("library_id", F.posexplode("documents").alias("position", "bibcode")).where(F.col("position") >= start)
    return found if rows is None else found.where(F.col("position") < start + rows)


def page_text(html: Column | str, least: int = 100) -> Column:
    """The text of a fetched page, or null where the fetch failed: under `least` characters of HTML."""
    return F.when(F.length(col(html)) >= least, html_to_text(html))


def arxiv_abstract(xml: Column | str) -> Column:
    """The abstract in an arXiv answer, white space collapsed, or null."""
    found = F.regexp_extract(col(xml), r"(?s)<summary>(.*?)</summary>", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))
