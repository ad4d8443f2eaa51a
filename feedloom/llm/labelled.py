"""Labelled documents for the classifiers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import held_out


def marks(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(__id, __label) of the ids outside the held-out fold: the largest label, null labels are none."""
    found = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    return found.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__label")).where(~held_out("__id", 5, 0))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_bytes: int,
           id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> list[tuple]:
    """(id, text, label, extra columns) of `per_class` documents of each class, or
    of all if there are fewer.

    A document qualifies if it has a label outside the held-out fold (crc32 of
    the id, modulo 5, is 0) and a text of at most `max_bytes`; of those the ones
    whose id has the smallest hash are taken.  An id with several labels has the
    largest; null labels are none.  Of rows that share an id the one with the
    shortest qualifying text counts (equal lengths: the smallest hash, then text).  A null
    text is empty.  The sample is the same however the tables are split.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text.alias("__text"), *[F.col(f"`{c}`").alias(f"__x{k}") for k, c in enumerate(extra)])
    rows = rows.withColumns({"__size": F.octet_length("__text"), "__hash": F.xxhash64("__text")}).where((F.col("__size") <= max_bytes) & F.col("__id").isNotNull())
    # Ids with sizes and hashes are shuffled, no texts.
    fit = rows.select("__id", "__size", "__hash").groupBy("__id").agg(F.min(F.struct("__size", "__hash")).alias("__own")).join(marks(labels, label_col, id_col), "__id")
    chosen = None
    for k in (0, 1):
        one = fit.where(F.col("__label") == k).orderBy(F.xxhash64(F.col("__id"), F.lit("sample")), "__id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    chosen = chosen.select("__id", "__label", "__own.__size", "__own.__hash")
    # At most 2 * per_class ids are broadcast, whatever the size of the tables.
    found = rows.join(F.broadcast(chosen), ["__id", "__size", "__hash"])
    one = F.struct("__text", "__label", *[f"__x{k}" for k in range(len(extra))])
    found = found.groupBy("__id").agg(F.min(one).alias("__one")).select("__id", "__one.*")
    return sorted(map(tuple, found.collect()), key=lambda r: r[0])  # 2 * per_class rows at most
