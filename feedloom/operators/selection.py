"""Source-diverse selection and de-duplication by rank, as window passes."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import config


def keep_first(rows: DataFrame, key: Column, order: Sequence[Column | str], group: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in the given order; rows with a null key all stay.

    Rows with a null key are numbered, so each is a key of its own: they spread over
    all tasks, and one condition on the place limits every group before its shuffle.
    """
    marked = rows.withColumn("__key", key).withColumn("__own", F.when(F.col("__key").isNull(), F.monotonically_increasing_id()))
    place = Window.partitionBy(*group, "__key", "__own").orderBy(*order)
    return marked.withColumn("__k", F.row_number().over(place)).where("__k = 1").drop("__key", "__own", "__k")


def least_items(most: int) -> int:
    return max(10, math.ceil(0.67 * most))


def source_caps(period: Column, limit: Column, category_most: int = 10) -> Column:
    """source_cap() of columns, by the name of the period; null for an unknown one."""
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in config.PERIOD_SOURCE_CAP.items() for x in pair]), period)
    return F.when(limit > category_most, F.ceil(cap * limit / category_most)).otherwise(cap)


def source_cap(period_cap: int, limit: int, category_most: int = 10) -> int:
    """The per-source cap, larger in proportion if more items than usual are asked for."""
    return math.ceil(period_cap * limit / category_most) if limit > category_most else period_cap


def best_of_sources(rows: DataFrame, per_source: int, most: int, score: str = "final", source: str = "source_title", group: Sequence[str] = ("category",), ties: Sequence[str] = ("id",), least: int | None = None, before: Sequence[str] = ()) -> DataFrame:
    """The rows that select_diverse() can take, with their rank among these: by score, or first by the columns of `before`.

    Of one source it takes at most min(per_source, most) rows and tops up with at
    most `least`, so worse rows of a source never count.  They go before the
    shuffle (a limit inside each window group), and what is then ranked in one
    group is a few rows of each source.
    """
    least = least_items(most) if least is None else least
    order = [*before, F.round(score, 9).desc(), *ties]
    in_source = Window.partitionBy(*group, source).orderBy(*order)
    rows = rows.withColumn("__s", F.row_number().over(in_source)).where(F.col("__s") <= min(per_source, most) + least).drop("__s")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def select_diverse(ranked: DataFrame, per_source: int = 2, most: int = 10, least: int | None = None, rank: str = "rank", source: str = "source_title", group: Sequence[str] = ("category",)) -> DataFrame:
    """Items of each group with `position` and `reason`.

    First the best `most` of those within their source's cap; if these are fewer
    than `least`, the best of the others follow until there are so many.
    """
    least = least_items(most) if least is None else least
    cap = Window.partitionBy(*group, source).orderBy(rank)
    rows = ranked.withColumn("__in_source", F.row_number().over(cap)).withColumn("__fits", F.col("__in_source") <= per_source)
    whole = Window.partitionBy(*group)
    first = Window.partitionBy(*group, "__fits").orderBy(rank)
    rows = rows.withColumn("__k", F.row_number().over(first))
    # Rows that can be neither taken nor topped up go before the windows over a group.
    rows = rows.where(F.col("__k") <= F.lit(most + least))
    rows = rows.withColumn("__taken", F.col("__fits") & (F.col("__k") <= most))
    rows = rows.withColumn("__n", F.sum(F.col("__taken").cast("int")).over(whole))
    spare = Window.partitionBy(*group, "__taken").orderBy(rank)
    rows = rows.withColumn("__s", F.row_number().over(spare))
    rows = rows.where(F.col("__taken") | (F.col("__n") + F.col("__s") <= least))
    position = F.when(F.col("__taken"), F.col("__s")).otherwise(F.col("__n") + F.col("__s"))
    reason = F.when(F.col("__taken"), F.concat(F.lit("Selected at rank "), position.cast("string"))).otherwise(F.lit("Selected (minimum threshold enforcement)"))
    return rows.withColumn("position", position).withColumn("reason", reason).drop("__in_source", "__fits", "__k", "__taken", "__n", "__s")
