"""Registered queries: each is a Spark plan and, where SQL can express it, DuckDB SQL
that was written on its own, so that the two check each other."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CATEGORIES = "['newsletters', 'podcasts', 'tech_articles', 'ai_news', 'product_news', 'community', 'research']"

#: The domain's tables in DuckDB, by name.
TABLES = {
    "items": f"""items AS (
  SELECT doc_id AS id, source AS source_title, split_part(text, chr(10), 1) AS title, text AS summary,
         ({_CATEGORIES})[doc_id % 7 + 1] AS category, 1767225600 - doc_id % 90 * 86400 AS published_at
  FROM documents)""",
    "urls": """urls AS (
  SELECT d.doc_id AS id, p.url FROM documents d JOIN pages p ON d.doc_id % (SELECT count(*) FROM pages) = p.page_id)""",
    "scores": """scores AS (
  SELECT doc_id AS item_id, CAST(quality * 5 + 4 - toxic * 2 AS DOUBLE) AS relevance, CAST(quality * 4 + 3.5 AS DOUBLE) AS usefulness,
         toxic = 1 AS off_topic, quality = 1 AS good, doc_id % 3 = 0 AS agentic, 1767225600 - 100 * 86400 AS scored_at
  FROM labels
  UNION ALL
  SELECT doc_id, CAST(quality * 5 + 4 - toxic * 2 - 1 AS DOUBLE), CAST(quality * 4 + 3.5 AS DOUBLE), toxic = 1, quality = 1, doc_id % 3 = 0, 1767225600 - 10 * 86400
  FROM labels)""",
    "firsts": """firsts AS (
  SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM scores t WHERE t.item_id = s.item_id AND t.scored_at < s.scored_at))""",
    "lasts": """lasts AS (
  SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM scores t WHERE t.item_id = s.item_id AND t.scored_at > s.scored_at))""",
}


def query(body: str | None = None, tables: str = "", name: str | None = None):
    """Register a plan under its function's name; `body` is SQL after the common
    tables named in `tables` (further tables of its own come first, with commas)."""

    def put(plan):
        key = name or plan.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = plan
        if body is not None:
            common = ", ".join(TABLES[t] for t in tables.split())
            text = body.strip()
            if common:
                text = f"WITH {common}" + (f", {text[5:]}" if text[:5].upper() == "WITH " else f" {text}")
            ORACLE_SQL[key] = text
        return plan

    return put


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the ranked and source-diverse items of every category."""
    return QUERIES["select_diverse"](spark, sf_dir)
