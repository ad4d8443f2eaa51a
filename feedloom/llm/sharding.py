"""Weighted rendezvous sharding of stable record keys, in DataFrame functions only.

Each shard draws a number from the key and its own number; the largest drawn
number, divided by weight, wins.  A shard that is added only takes rows to
itself.  Slots number the rows of a shard without gaps and without one task
holding a shard: rows are counted by (shard, bucket), the small table of
counts gives each bucket its first slot, and only a bucket is ever sorted.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of the largest shard holds on average, and copies of a row that one task writes.
BUCKET_ROWS, COPIES = 50_000, 1_000_000


def shard_of(keys: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """The shard, from 0, of a record with these key columns.

    Null keys are keys like any other: equal keys go to one shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    drawn = []
    for k, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.lit(k), *[F.col(c) if isinstance(c, str) else c for c in keys]), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        drawn.append(F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("draw"), F.lit(k).alias("shard")))
    return F.array_max(F.array(*drawn))["shard"] if len(drawn) > 1 else F.lit(0)


def with_slots(rows: DataFrame, shard_col: str, order_cols: Sequence[str], n_rows: int, shards: float) -> DataFrame:
    """`rows` with `slot`: 0, 1, 2 and so on inside each shard; the largest has about
    one in `shards` of all rows.

    Equal rows are interchangeable, so they are counted before anything is sorted: a
    row that is a third of a table is one row with a count, which takes as many slots
    and is written out again at the end, large counts by several tasks.
    """
    buckets = max(1, math.ceil(n_rows / (BUCKET_ROWS * shards)))
    rest = [c for c in rows.columns if c not in order_cols]
    dealt = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    dealt = dealt.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), *order_cols), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy(shard_col, "__bucket").agg(F.sum("__n").alias("__all"))
        .withColumn("__first", F.coalesce(F.sum("__all").over(before), F.lit(0)))
        .drop("__all")
    )
    inside = Window.partitionBy(shard_col, "__bucket").orderBy(*order_cols, *rest).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("__k", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(first, [shard_col, "__bucket"])
    numbered = numbered.select(*rows.columns, "__n", (F.col("__first") + F.col("__k")).alias("__slot"))
    parts = numbered.where(F.col("__n") > COPIES).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))
    parts = parts.withColumns({"__n": F.least(F.lit(COPIES).cast("long"), F.col("__n") - F.col("__from")), "__slot": F.col("__slot") + F.col("__from")}).drop("__from")
    every = numbered.where(F.col("__n") <= COPIES).unionByName(parts.repartition("__slot"))
    return every.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).select(*rows.columns, (F.col("__slot") + F.col("__i")).cast("long").alias("slot"))


def shard_table(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    The law is `key`: id and number of shards decide, so repeated ids share a
    shard, rows with a null id share one, and equal texts need not.  A null
    text has size 1 and the checksum of no bytes.  grown_shard is the shard with
    one more of the first weight.  Rows equal in id, size and checksum take slots of
    one shard in any order; a very long text is sized and summed like any other.  An
    empty table gives no rows; other columns are not read.
    """
    weights = list(weights) if weights else [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of([id_col], weights).alias("shard"),
        shard_of([id_col], [*weights, weights[0]]).alias("grown_shard"),
    )
    # The count comes from file footers, without reading a column.
    out = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], docs.count(), sum(weights) / max(weights))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
