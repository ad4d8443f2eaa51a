"""Distributions, coverage and counts."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.sources.places import new_place


def beside(rows: DataFrame, more: DataFrame, group: Sequence[str], how: str = "left") -> DataFrame:
    """`rows` with the other columns of their group's row; null is a group of its own."""
    if not group:
        return rows.crossJoin(F.broadcast(more))  # one row
    more = more.withColumnsRenamed({g: f"__of_{g}" for g in group})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in group])
    return rows.join(more, same, how).drop(*[f"__of_{g}" for g in group])


def histogram(rows: DataFrame, value: str, buckets: int, group: Sequence[str] = ()) -> DataFrame:
    """(group..., bucket, low, n): equal widths between a group's least and largest
    value; empty buckets stay, the largest value is in the last, and a range of 0
    counts as 1."""
    rows = rows.where(F.col(value).isNotNull())
    ends = rows.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.withColumn("span", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)))
    at = F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("lo")) / F.col("span") * buckets)).cast("int")
    counts = beside(rows.select(*group, value), ends, group).groupBy(*group, at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(*group, "lo", "span", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    found = beside(every, counts, [*group, "bucket"])
    return found.select(*group, "bucket", (F.col("lo") + F.col("span") * F.col("bucket") / buckets).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


#: Values of a group that one task may sort.
FITS = 100_000


def upper_median(rows: DataFrame, value: str, group: Sequence[str] = (), fits: int = FITS) -> DataFrame:
    """(group..., median): the element at index floor(n / 2) of the sorted values (not
    the mean of the middle two); nulls don't count.

    Selection by rank.  Each round cuts the values that are left of a large group at
    percentiles around the wanted rank, counts exactly what lies below and at the
    cuts, and keeps what lies between them, a few hundredths; a cut that has the rank
    itself is the median.  So a round is one aggregate of counts, and only groups of at
    most `fits` values are ever sorted.  Brackets are written between rounds.
    """
    values = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    kind = values.schema["__v"].dataType
    nothing = F.lit(None).cast(kind)
    # `k` is the wanted rank among the `left` values strictly between `lo` and `hi`.
    now = values.groupBy(*group).agg(F.count(F.lit(1)).alias("left")).select(*group, F.floor(F.col("left") / 2).alias("k"), "left", nothing.alias("lo"), nothing.alias("hi"), nothing.alias("median"))
    if not group:
        now = now.where("left > 0")

    def inside(brackets: DataFrame) -> DataFrame:
        met = beside(values, brackets.select(*group, "k", "left", "lo", "hi"), group, "inner")
        return met.where((F.col("lo").isNull() | (F.col("__v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") < F.col("hi"))))

    spark, places = rows.sparkSession, []
    while True:
        places.append(new_place(spark, "median"))
        schema = now.schema
        now.write.parquet(places[-1])
        now = spark.read.schema(schema).parquet(places[-1])
        open_ones = F.col("median").isNull() & (F.col("left") > fits)
        if not now.where(open_ones).take(1):
            break
        marks = [F.lit(k / 50) for k in range(51)]
        cuts = inside(now.where(open_ones)).groupBy(*group).agg(F.first("k").alias("k"), F.first("left").alias("left"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.percentile_approx("__v", F.array(*marks), F.lit(10_000)).alias("m"))
        at = F.floor(F.col("k") / F.col("left") * 50).cast("int")
        cuts = cuts.select(*group, "k", "left", "lo", "hi", F.get("m", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("m", F.least(at + 2, F.lit(50))).alias("b"))
        met = beside(values, cuts, group, "inner").where((F.col("lo").isNull() | (F.col("__v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") < F.col("hi"))))
        v, a, b = F.col("__v"), F.col("a"), F.col("b")
        sums = met.groupBy(*group).agg(*[F.first(c).alias(c) for c in ("k", "left", "lo", "hi", "a", "b")], F.count_if(v < a).alias("n0"), F.count_if(v == a).alias("n1"), F.count_if((v > a) & (v < b)).alias("n2"), F.count_if((v == b) & (a < b)).alias("n3"))
        k = F.col("k") - F.col("n0")
        below, at_a, between, at_b = F.col("k") < F.col("n0"), (k >= 0) & (k < F.col("n1")), (k >= F.col("n1")) & (k < F.col("n1") + F.col("n2")), (k >= F.col("n1") + F.col("n2")) & (k < F.col("n1") + F.col("n2") + F.col("n3"))
        new = sums.select(
            *group,
            F.when(below, F.col("k")).when(between, k - F.col("n1")).otherwise(F.col("k") - F.col("n0") - F.col("n1") - F.col("n2") - F.col("n3")).alias("k"),
            F.when(below, F.col("n0")).when(between, F.col("n2")).otherwise(F.col("left") - F.col("n0") - F.col("n1") - F.col("n2") - F.col("n3")).alias("left"),
            F.when(below, F.col("lo")).when(between, a).otherwise(b).alias("lo"), F.when(below, a).when(between, b).otherwise(F.col("hi")).alias("hi"),
            F.when(at_a, a).when(at_b, b).alias("median"),
        )
        now = now.where(~open_ones).unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
    order = Window.partitionBy(*group).orderBy("__v")
    counts = inside(now.where("median is null")).groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).withColumn("upto", F.sum("n").over(order))
    hit = counts.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))).select(*group, F.col("__v").alias("median"))
    return now.where("median is not null").select(*group, "median").unionByName(hit)


def long_form(rows: DataFrame, values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., metric, value): one row for each of the columns."""
    pairs = ", ".join(f"'{v}', cast(`{v}` as double)" for v in values)
    return rows.selectExpr(*keep, f"stack({len(values)}, {pairs}) as (metric, value)")


def distribution(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    return long_form(rows, values).groupBy("metric").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def coverage(rows: DataFrame, have: Column, failed: Column, group: Sequence[str]) -> DataFrame:
    """Counts of rows that have something, failed, or were never tried, and the share that has it."""
    none = ~have & ~failed
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(have).alias("cached"), F.count_if(failed).alias("errors"), F.count_if(none).alias("never"),
        F.round(100.0 * F.count_if(have) / F.count(F.lit(1)), 1).alias("pct"),
    )


def themes(rows: DataFrame, text: Column, tags: Column, weights: dict[str, float], topics: Sequence[str] = ()) -> DataFrame:
    """(theme, weight): the weights of themes that occur in texts, one for each tag; 2.5 times for topics."""
    lower = F.lower(text)
    named = F.array_compact(F.array(*[F.when(lower.contains(t), F.struct(F.lit(t).alias("theme"), F.lit(float(w)).alias("w"))) for t, w in weights.items()]))
    tagged = F.transform(tags, lambda t: F.struct(t.alias("theme"), F.lit(1.0).alias("w")))
    out = rows.select(F.explode(F.concat(named, tagged)).alias("x")).groupBy(F.col("x.theme").alias("theme")).agg(F.sum("x.w").alias("weight"))
    if topics:
        hit = F.exists(F.array(*[F.lit(t.lower()) for t in topics]), lambda t: F.lower("theme").contains(t) | t.contains(F.lower("theme")))
        out = out.withColumn("weight", F.when(hit, F.col("weight") * 2.5).otherwise(F.col("weight")))
    return out


def first_bucket(text: Column | str, kinds: Sequence[tuple[str, str]], other: str) -> Column:
    """The name of the first kind whose word is in the text (ASCII case doesn't count), or `other`."""
    lower, out = F.lower(F.col(text) if isinstance(text, str) else text), None
    for word, name in kinds:
        hit = F.coalesce(lower.contains(word), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other) if out is not None else F.lit(other)
