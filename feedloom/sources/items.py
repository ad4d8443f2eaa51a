"""The domain's tables from the driver's tables, and feed files.

Items are documents: the title is the first line, categories and times follow
from the id, urls come from pages, scores from labels (two a document, at
different times), vectors from embeddings.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import config

#: 2026-01-01 in UTC, the time that all queries are asked at.
AS_OF = 1_767_225_600
DAY = 86_400
#: Bytes of a table that may be dealt anew.
SMALL_TABLE = 256 << 20

FEED_ARTICLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("published", T.LongType()), T.StructField("updated", T.LongType()), T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("canonical", T.ArrayType(T.StructType([T.StructField("href", T.StringType())]))),
    T.StructField("alternate", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("type", T.StringType())]))),
    T.StructField("summary", T.StructType([T.StructField("content", T.StringType())])),
    T.StructField("origin", T.StructType([T.StructField("streamId", T.StringType()), T.StructField("title", T.StringType()), T.StructField("htmlUrl", T.StringType())])),
])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, most_bytes: int = SMALL_TABLE) -> DataFrame:
    """A small table's rows dealt anew if they are in fewer splits than the session has
    cores, so that costly work on texts uses all of them: a file of one row group is
    one split whatever the split size.  Tables of over `most_bytes` are never
    shuffled for that, on any session."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= most_bytes and rows.rdd.getNumPartitions() < cores else rows


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items() for plans that work on the texts."""
    return _items(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_title, title, summary, category, published_at (epoch seconds)."""
    return _items(read(spark, sf_dir, "documents"))


def _items(documents: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(c) for c in config.CATEGORIES])
    return documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_title"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.col("text").alias("summary"),
        F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("category"), (F.lit(AS_OF) - F.col("doc_id") % 90 * DAY).alias("published_at"),
    )


def with_urls(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a page's url; pages are fewer, so urls repeat."""
    pages = read(spark, sf_dir, "pages")
    n = pages.count()  # from the file footers
    return rows.join(pages.select(F.col("page_id"), "url"), F.col("id") % max(n, 1) == F.col("page_id")).drop("page_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, scored_at, relevance, usefulness, tags: an old and a new score for each labelled document."""
    base = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), (F.col("quality") * 5 + 4 - F.col("toxic") * 2).cast("double").alias("relevance"), (F.col("quality") * 4 + 3.5).cast("double").alias("usefulness"),
        F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("off-topic")), F.when(F.col("doc_id") % 3 == 0, F.lit("agent")))).alias("tags"),
    )
    old = base.withColumn("scored_at", F.lit(AS_OF - 100 * DAY))
    new = base.withColumn("scored_at", F.lit(AS_OF - 10 * DAY)).withColumn("relevance", F.col("relevance") - 1)
    return old.unionByName(new)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    """One row with column q."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def feed_config(spark: SparkSession) -> DataFrame:
    """A small dimension: half of the sources with a name and a default category."""
    return spark.range(0, 20, 2).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("stream_id"), F.concat(F.lit("Feed "), F.col("id").cast("string")).alias("canonical_name"),
                                        F.element_at(F.array(*map(F.lit, config.CATEGORIES)), (F.col("id") % 7 + 1).cast("int")).alias("default_category"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed pages: one article a line, with an explicit schema."""
    return spark.read.schema(FEED_ARTICLE).json(path)


def stream_feed(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(FEED_ARTICLE).option("maxFilesPerTrigger", files_a_batch).json(path)


def normalize(articles: DataFrame, aggregators: tuple[str, ...] = ()) -> DataFrame:
    """Feed articles to items: the first good url, a snippet of 500 characters, labels without their folders."""
    content = F.coalesce("summary.content", F.lit(""))
    links = F.regexp_extract_all(content, F.lit(r'href="(https?://[^"]+)"'), F.lit(1))
    links = F.filter(links, lambda u: ~reduce(lambda bad, host: bad | u.contains(host), aggregators, F.lit(False)))
    return articles.select(
        "id", F.col("origin.streamId").alias("stream_id"), F.coalesce("origin.title", F.lit("Unknown")).alias("source_title"), F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce(F.get(F.col("canonical.href"), F.lit(0)), F.get(F.col("alternate.href"), F.lit(0)), F.get(links, F.lit(0)), F.lit("")).alias("url"), "author",
        F.col("published").alias("published_at"), content.alias("summary"), F.substring(content, 1, 500).alias("content_snippet"),
        F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.element_at(F.split(c, "/"), -1)).alias("categories"),
    )


def categorize(rows: DataFrame, folders: dict[str, str], default: str = "newsletters", feeds: DataFrame | None = None) -> DataFrame:
    """Items with a category: their feed's, else that of the first label that maps, else the default."""
    mapping = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair]) if folders else F.create_map().cast("map<string,string>")
    named = F.get(F.filter(F.transform("categories", lambda c: F.element_at(mapping, c)), lambda c: c.isNotNull()), F.lit(0))
    if feeds is None:
        return rows.withColumn("category", F.coalesce(named, F.lit(default)))
    small = feeds.select("stream_id", F.col("default_category").alias("__feed"))
    return rows.join(small, "stream_id", "left").withColumn("category", F.coalesce("__feed", named, F.lit(default))).drop("__feed")
