"""What a language model's reply to a batch of items says, and which papers it cites."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import col

SCORES = "array<struct<relevance:double,usefulness:double,tags:array<string>>>"


def batch_scores(batches: DataFrame, ids: str = "ids", reply: str = "reply") -> DataFrame:
    """(id, relevance, usefulness, tags) for each id of a batch, by the reply's first
    to last bracket.  A score that is missing or zero counts as 5, others are kept
    within 0 to 10, tags that are no list are none.  Where the reply has no list, or
    one of another length than the batch, every item has 5, 5 and no tags."""
    found = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*\]", 0), SCORES)
    good = F.coalesce(F.size(found) == F.size(ids), F.lit(False))
    rows = batches.select(F.when(good, found).alias("__found"), F.posexplode(ids).alias("__k", "id"))
    own = F.get("__found", F.col("__k"))
    score = lambda c: F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(5.0))))
    return rows.select("id", score(own["relevance"]).alias("relevance"), score(own["usefulness"]).alias("usefulness"), F.coalesce(own["tags"], F.array().cast("array<string>")).alias("tags"))


def citations(answer: Column | str, papers: Column | int) -> Column:
    """Numbers in brackets, from 1 to the number of papers, each once, in the order of the answer."""
    most = papers if isinstance(papers, Column) else F.lit(papers)
    found = F.transform(F.regexp_extract_all(col(answer), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("long"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= most)))


def retry_after(failures: Column | str) -> Column:
    """Seconds to wait after so many failures in a row: a minute, doubled each time, up to eight hours."""
    return F.least(F.lit(60.0) * F.pow(F.lit(2.0), col(failures) - 1), F.lit(28_800.0)).cast("long")


def _said(seconds: Column) -> Column:
    """A time in seconds, minutes or hours."""
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(seconds < 60, F.concat(whole(seconds), F.lit("s"))).when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m"))).otherwise(F.concat(whole(seconds / 3600), F.lit("h")))


def backoff_status(keys: DataFrame, key: str, as_of: int) -> DataFrame:
    """Rows whose cache key tells of failures ("backoff_<resource>_attempts_<n>_lastFailure_<seconds>"),
    with resource, attempts, failed_at, retry_at, the ages of both in words and whether a try is due."""
    part = lambda k: F.regexp_extract(F.col(key), r"backoff_([A-Za-z0-9_]+)_attempts_([0-9]+)_lastFailure_([0-9]+)", k)
    rows = keys.where(part(1) != "").select("*", part(1).alias("resource"), part(2).try_cast("long").alias("attempts"), part(3).try_cast("long").alias("failed_at"))
    rows = rows.withColumn("retry_at", F.col("failed_at") + retry_after("attempts"))
    return rows.withColumns({"age": _said(F.lit(as_of) - F.col("failed_at")), "wait": _said(F.greatest(F.lit(0), F.col("retry_at") - as_of)), "can_retry": F.col("retry_at") <= as_of})


def backoff_key(resource: Column | str, attempts: Column | str, failed_at: Column | str) -> Column:
    return F.concat(F.lit("backoff_"), col(resource), F.lit("_attempts_"), col(attempts).cast("string"), F.lit("_lastFailure_"), col(failed_at).cast("string"))


def feeds_cache(feeds: DataFrame, group: list[str], at: str, as_of: int, hours: int = 6) -> DataFrame:
    """(group..., last_refresh_at, count, expires_at, expired): how many feeds were
    refreshed, when last, and until when they are good."""
    rows = feeds.groupBy(*group).agg(F.max(at).alias("last_refresh_at"), F.count(F.lit(1)).alias("count"))
    rows = rows.withColumn("expires_at", F.col("last_refresh_at") + hours * 3600)
    return rows.withColumn("expired", F.col("expires_at") <= as_of)


def authors_label(authors: Column | str, most: int = 3) -> Column:
    """The first names of a JSON list, and "et al." if there are more; a text that is no list as it is."""
    who = F.from_json(col(authors), "array<string>")
    short = F.concat(F.array_join(F.slice(who, 1, most), ", "), F.when(F.size(who) > most, " et al.").otherwise(""))
    return F.coalesce(short, col(authors))


def year_of(pubdate: Column | str) -> Column:
    """The year that a publication date begins with, or null."""
    return F.substring(col(pubdate), 1, 4).try_cast("int")
