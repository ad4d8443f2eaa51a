"""Writes as table transforms: the new table from the old one and a batch.

A null in a key is a value like any other: it equals a null, so a batch that is
replayed changes nothing, whatever its keys are.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`; of equal ones always the same."""
    place = Window.partitionBy(*key).orderBy(F.desc(order), F.xxhash64(*batch.columns))
    return batch.withColumn("__k", F.row_number().over(place)).where("__k = 1").drop("__k")


def _same(key: Sequence[str], a: str = "o", b: str = "n") -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key])


def _without(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the table whose key is not among `keys`."""
    return table.alias("o").join(keys.select(*key).alias("n"), _same(key), "left_anti")


def replace(table: DataFrame, batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Whole rows of the batch replace those of the table; columns that the batch
    lacks become null, which loses what they held.  The last of a batch wins."""
    new = last_of(batch, key, order).drop(order)
    return _without(table, new, key).unionByName(new, allowMissingColumns=True)


def merge(table: DataFrame, batch: DataFrame, key: Sequence[str], order: str, keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Rows of the batch update the table's; a null in `keep_if_null` columns keeps the old value."""
    new = last_of(batch, key, order).drop(order).withColumn("__new", F.lit(True))
    joined = table.withColumn("__old", F.lit(True)).alias("o").join(new.alias("n"), _same(key), "full_outer")

    def value(c: str) -> Column:
        old = F.col(f"o.{c}")
        if c not in new.columns:
            return old
        if c in key:
            return F.when(F.col("__old"), old).otherwise(F.col(f"n.{c}"))
        if c in keep_if_null:
            return F.coalesce(F.col(f"n.{c}"), old)
        return F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(old)

    return joined.select(*[value(c).alias(c) for c in [*key, *(c for c in table.columns if c not in key)]])


def insert_ignore(table: DataFrame, batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of the batch whose key is new; the first of a batch wins."""
    place = Window.partitionBy(*key).orderBy(order, F.xxhash64(*batch.columns))
    first = batch.withColumn("__k", F.row_number().over(place)).where("__k = 1").drop("__k", order)
    return table.unionByName(_without(first, table, key))


def delete(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return _without(table, keys, key)


def update(table: DataFrame, patch: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The patch's columns where its key matches; the key is unique in the patch."""
    joined = table.alias("o").join(patch.select(*key, *columns).withColumn("__hit", F.lit(True)).alias("n"), _same(key), "left")
    value = lambda c: F.when(F.col("__hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in columns else F.col(f"o.{c}")
    return joined.select(*[value(c).alias(c) for c in table.columns])


def counters(log: DataFrame, key: str, amount: str) -> DataFrame:
    """An append-only log of amounts as one counter for each key."""
    return log.groupBy(key).agg(F.sum(amount).alias("used"))
