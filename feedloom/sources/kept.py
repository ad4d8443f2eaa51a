"""State that is kept beside growing tables: first and last scores, vectors by content."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.sources.versions import SnapshotTable


class ScoreState:
    """The first and the last score of each item, kept while scores are appended.

    An append adds its batch to the history and merges the batch's own first and last
    scores into the state, of which only the files with one of its items are read; so
    a join with the oldest or the latest score reads a row an item, not the history.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "item_id", at: str = "scored_at", bucket_rows: int = 1 << 20) -> None:
        self.spark, self.key, self.at = spark, key, at
        self.history = SnapshotTable(spark, f"{path}/history", [key], bucket_rows)
        self.ends = SnapshotTable(spark, f"{path}/ends", [key], bucket_rows)

    def _ends(self, scores: DataFrame) -> DataFrame:
        rest = [c for c in scores.columns if c != self.key]
        place = F.struct(self.at, F.xxhash64(*rest))
        return scores.groupBy(self.key).agg(F.min_by(F.struct(*rest), place).alias("first"), F.max_by(F.struct(*rest), place).alias("last"))

    def _merged(self, batch: DataFrame) -> DataFrame:
        """The batch's ends and those that the state has for its items."""
        new = self._ends(batch)
        old = self.ends.read()
        if old is None:
            return new
        met = old.join(new.select(F.col(self.key).alias("__key")), F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")
        both = met.unionByName(new)
        hashed = lambda c: F.struct(F.col(f"{c}.{self.at}"), F.xxhash64(*[F.col(f"{c}.{x.name}") for x in both.schema[c].dataType]))
        return both.groupBy(self.key).agg(F.min_by("first", hashed("first")).alias("first"), F.max_by("last", hashed("last")).alias("last"))

    def append(self, scores: DataFrame, writer: str, batch: int) -> bool:
        """Add a numbered batch of a writer; one that is there already adds nothing.
        The state is merged before the history is written, and merging twice gives the
        same, so a run that is lost between them is made good by its replay."""
        if self.history.applied(writer) >= batch:
            return False
        self.ends.upsert(self._merged(scores).withColumn("__seq", F.lit(0)), "__seq", "replace")
        return self.history.append(scores, writer, batch)

    def _of(self, end: str) -> DataFrame:
        rows = self.ends.read()
        if rows is None:
            raise ValueError("no scores yet")
        return rows.select(self.key, f"{end}.*")

    def first(self) -> DataFrame:
        return self._of("first")

    def last(self) -> DataFrame:
        return self._of("last")


class VectorStore:
    """Vectors of items, made once for each content.

    A row has the digest of the text that its vector was made from.  What is asked for
    is compared by item and digest; only rows whose text is new or changed are handed
    to `embed`, and the others keep their vectors.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column], key: str = "item_id", bucket_rows: int = 1 << 18) -> None:
        self.spark, self.embed, self.key = spark, embed, key
        self.table = SnapshotTable(spark, path, [key], bucket_rows)

    def missing(self, texts: DataFrame) -> DataFrame:
        """Rows of `texts` (key, text) without a vector of just this text, with the digest."""
        rows = texts.select(self.key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        have = self.table.read()
        if have is None:
            return rows
        have = have.select(F.col(self.key).alias("__key"), F.col("digest").alias("__digest"))
        return rows.join(have, F.col(self.key).eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__digest")), "left_anti")

    def refresh(self, texts: DataFrame) -> int:
        """Make and keep the vectors that `texts` lacks; how many.  Keys of `texts` are unique."""
        rows = self.missing(texts).select(self.key, "digest", self.embed(F.coalesce("text", F.lit(""))).alias("embedding"), F.lit(0).alias("__seq")).persist()
        try:
            n = rows.count()
            if n:
                self.table.upsert(rows, "__seq", "replace")
            return n
        finally:
            rows.unpersist()

    def read(self) -> DataFrame:
        rows = self.table.read()
        if rows is None:
            raise ValueError("no vectors yet")
        return rows.select(self.key, "embedding")
