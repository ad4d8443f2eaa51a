"""What readers say of items and sources, and the feeds that are read: small stored tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.urls import hostname
from feedloom.sources.versions import SnapshotTable

#: Ratings go from 0 to this.
BEST = 3


class Ratings:
    """Ratings and stars of items, and how relevant sources are.

    Batches are upserts in the order of `seq`: a rating sets rating, notes and time
    (a null takes a rating back) and leaves the star; a star leaves the rating.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.items = SnapshotTable(spark, f"{path}/items", ["item_id"])
        self.sources = SnapshotTable(spark, f"{path}/sources", ["stream_id"])
        self.spark = spark

    @staticmethod
    def _checked(batch: DataFrame, column: str) -> None:
        if batch.where(F.col(column).isNotNull() & ~F.col(column).between(0, BEST)).take(1):
            raise ValueError(f"{column} must be from 0 to {BEST}, or null")

    def _put(self, batch: DataFrame) -> None:
        for name, kind in (("rating", "int"), ("notes", "string"), ("rated_at", "long"), ("starred", "boolean")):
            if self.items.read() is None and name not in batch.columns:
                batch = batch.withColumn(name, F.lit(None).cast(kind))
        self.items.upsert(batch, "seq", "merge", keep_if_null=[])

    def rate(self, batch: DataFrame) -> None:
        """batch: item_id, rating, notes, rated_at, seq."""
        self._checked(batch, "rating")
        self._put(batch.select("item_id", F.col("rating").cast("int").alias("rating"), "notes", F.col("rated_at").cast("long").alias("rated_at"), "seq"))

    def star(self, batch: DataFrame) -> None:
        """batch: item_id, starred, seq."""
        self._put(batch.select("item_id", "starred", "seq"))

    def of(self, ids: DataFrame, key: str = "item_id") -> DataFrame:
        """(item_id, rating, notes, rated_at, starred) of each asked item; unknown ones have no rating and no star."""
        have = self.items.read()
        asked = ids.select(F.col(key).alias("item_id"))
        if have is None:
            return asked.select("item_id", *[F.lit(None).cast(t).alias(n) for n, t in (("rating", "int"), ("notes", "string"), ("rated_at", "long"))], F.lit(False).alias("starred"))
        return asked.join(have, "item_id", "left").select("item_id", "rating", "notes", "rated_at", F.coalesce("starred", F.lit(False)).alias("starred"))

    def set_sources(self, batch: DataFrame) -> None:
        """batch: stream_id, relevance, seq."""
        self._checked(batch, "relevance")
        self.sources.upsert(batch.select("stream_id", F.col("relevance").cast("int").alias("relevance"), "seq"), "seq", "replace")

    def source_factors(self, feeds: DataFrame) -> DataFrame:
        """`feeds` with the relevance of each source (1 if none is set) and the factor that its items' scores take."""
        have = self.sources.read()
        rows = feeds.withColumn("relevance", F.lit(None).cast("int")) if have is None else feeds.join(have, "stream_id", "left")
        factor = F.create_map(*[F.lit(x) for pair in config.SOURCE_MULTIPLIER.items() for x in pair])
        return rows.withColumn("relevance", F.coalesce("relevance", F.lit(1))).withColumn("factor", F.element_at(factor, F.col("relevance")))


def feeds_of(subscriptions: DataFrame, folders: dict[str, str], default: str = "newsletters") -> DataFrame:
    """(stream_id, canonical_name, default_category, tags, vendor) of subscriptions
    (stream_id, title, html_url, labels): the first label decides the category, in any
    case, and the vendor is the site's host."""
    first = F.lower(F.get("labels", F.lit(0)))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in folders.items() for x in pair]), first) if folders else F.lit(None).cast("string")
    return subscriptions.select("stream_id", F.col("title").alias("canonical_name"), F.coalesce(named, F.lit(default)).alias("default_category"), F.col("labels").alias("tags"), hostname("html_url").alias("vendor"))


def refresh_feeds(table: SnapshotTable, subscriptions: DataFrame, folders: dict[str, str]) -> None:
    """Put what is subscribed to into the table of feeds, by stream."""
    table.upsert(feeds_of(subscriptions, folders).withColumn("seq", F.lit(0)), "seq", "replace")
