"""Episodes: rundowns, fallback scripts, and segments of transcripts with their times."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import config
from feedloom.functions.text import col, format_mmss, half_up


def spoken_seconds(text: Column | str) -> Column:
    """Seconds at 150 words a minute; words are what white space parts, so a space at an end counts one more."""
    return F.ceil(F.size(F.split(col(text), r"\s+")) / F.lit(150.0) * 60).cast("long")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def references(text: Column) -> Column:
    """Numbers of the items that a text refers to, "(ref: item-<n>)", each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\(ref:\s*item-([0-9]+)\)"), F.lit(1)), lambda n: n.cast("int")))


def highlights(text: Column, most: int = 3) -> Column:
    """The first lines with a dash, without it and without references, of more than ten characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("—") | _trimmed(x).startswith("-"))
    clean = F.transform(lines, lambda x: _trimmed(F.regexp_replace(F.regexp_replace(x, r"^[-\s]+", ""), r"\(ref:.*?\)", "")))
    return F.slice(F.filter(clean, lambda x: F.length(x) > 10), 1, most)


def segments(transcripts: DataFrame, key: str = "id", script: str = "script") -> DataFrame:
    """(key, n, title, start, stop, start_time, end_time, duration, refs, highlights):
    the parts of each transcript after "## SEGMENT:" marks, one after the other in
    time; one without marks is a single "Full Episode" from 0:00."""
    parts = F.split(F.col(script), r"##\s*SEGMENT:\s*")
    rows = transcripts.select(key, F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts) - 1)).alias("__parts"), F.col(script).alias("__all"))
    rows = rows.select(key, F.posexplode(F.coalesce("__parts", F.array("__all"))).alias("n", "__part"), F.col("__parts").isNull().alias("__whole"))
    line = F.regexp_extract("__part", r"^[^\n]*", 0)
    body = F.when(F.col("__whole"), F.col("__part")).otherwise(F.regexp_replace("__part", r"^[^\n]*\n?", ""))
    title = F.when(F.col("__whole"), "Full Episode").otherwise(_trimmed(F.when(line == "", F.concat(F.lit("Segment "), (F.col("n") + 1).cast("string"))).otherwise(line)))
    rows = rows.select(key, "n", title.alias("title"), body.alias("__body"), "__whole").withColumn("duration", spoken_seconds("__body"))
    stop = F.sum("duration").over(Window.partitionBy(key).orderBy("n"))
    rows = rows.withColumns({"stop": stop, "start": stop - F.col("duration")})
    none = F.array().cast("array<string>")
    return rows.select(key, "n", "title", "start", "stop", format_mmss("start").alias("start_time"), format_mmss("stop").alias("end_time"), "duration",
                       references(F.col("__body")).alias("refs"), F.when(F.col("__whole"), none).otherwise(highlights(F.col("__body"))).alias("highlights"))


def referenced(found: DataFrame, items: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """One row for each reference of a segment: the item in that place (from 0) of the
    episode's items (key, position, item_id, title, url, source_title), or an unknown one."""
    refs = found.select(key, "n", F.explode("refs").alias("__ref"))
    own = items.select(key, F.col(position).alias("__ref"), "item_id", "title", "url", "source_title")
    rows = refs.join(own, [key, "__ref"], "left")
    missing = F.concat(F.lit("item-"), F.col("__ref").cast("string"))
    return rows.select(key, "n", F.col("__ref").alias("ref"), F.coalesce(F.col("item_id").cast("string"), missing).alias("item_id"), F.coalesce("title", F.lit("Unknown")).alias("title"),
                       F.coalesce("url", F.lit("#")).alias("url"), F.coalesce("source_title", F.lit("Unknown")).alias("source_title"))


def rundown(digests: DataFrame, group: Sequence[str], order: Sequence[Column | str], key: str = "id") -> DataFrame:
    """`digests` with `band` (segment, lightning or cut), `place` (from 1, null for
    cuts) and `seconds`: the first four of each episode are segments, the next
    three lightning, and all others the cut list.  Only the first seven are
    ordered; `key` is unique in an episode."""
    most = config.RUNDOWN_SEGMENTS + config.RUNDOWN_LIGHTNING
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    top = digests.withColumn("place", place).where(F.col("place") <= most).select(*group, key, "place")
    band = F.when(F.col("place") <= config.RUNDOWN_SEGMENTS, "segment").when(F.col("place").isNotNull(), "lightning").otherwise("cut")
    return digests.join(top, [*group, key], "left").withColumns({"band": band, "seconds": F.when(band == "segment", config.SEGMENT_SECONDS).otherwise(0)})


def fallback_script(episodes: DataFrame, key: str) -> DataFrame:
    """(key, stories, script, seconds): a spoken script for the segments of each
    rundown; takes rows of rundown() with one_line_takeaway and key_facts."""
    name = F.substring("one_line_takeaway", 1, 50)
    of = F.when(F.col("band") == "segment", F.struct("place", name.alias("name"), F.array_join(F.slice("key_facts", 1, 2), " ").alias("points")))
    rows = episodes.groupBy(key).agg(F.count(F.lit(1)).alias("stories"), F.array_sort(F.collect_list(of)).alias("__s"))  # four segments at most
    intros = F.array(*map(F.lit, config.SEGMENT_INTROS))

    def said(x):
        intro = F.element_at(intros, F.pmod(x["place"] - 1, F.lit(len(config.SEGMENT_INTROS))) + 1)
        return F.concat(F.lit("## "), x["name"], F.lit("\n\n**HOST:** "), intro, F.lit(" "), F.lower(x["name"]), F.lit(". "), x["points"], F.lit("\n\n[PAUSE]\n\n"))

    # What is said first and last.
    head = F.concat(F.lit("[INTRO MUSIC]\n\n**HOST:** Welcome to this week's code intelligence digest. I'm your host.\n\n**COHOST:** And I'm your co-host. Today we're covering "), F.col("stories").cast("string"),
                    F.lit(" stories on code search, agents, and developer tools.\n\n"))
    tail = F.lit("**HOST:** That's all for this week. Thanks for listening. Check the show notes for all links.\n\n[OUTRO MUSIC]")
    rows = rows.withColumn("script", F.concat(head, F.array_join(F.transform("__s", said), ""), tail))
    return rows.select(key, "stories", "script", spoken_seconds("script").alias("seconds"))


def script_times(planned: DataFrame, spoken: DataFrame, key: str, order: str = "place", seconds: str = "seconds", total: str = "spoken") -> DataFrame:
    """Segments (key, order, seconds) with start, stop and duration in the spoken time
    of their script (key, total): after 30 seconds of intro, the time without a
    minute of frame is dealt in proportion to what was planned."""
    rows = planned.join(spoken.select(key, total), key)
    share = F.col(seconds) / F.sum(seconds).over(Window.partitionBy(key))
    rows = rows.withColumn("duration", half_up((F.col(total) - 60) * share).cast("long"))
    stop = F.sum("duration").over(Window.partitionBy(key).orderBy(order)) + 30
    return rows.withColumns({"stop": stop, "start": stop - F.col("duration")}).drop(total)


def planned_times(planned: DataFrame, key: str, order: str = "place", seconds: str = "seconds") -> DataFrame:
    """Segments with start and stop from the planned seconds alone."""
    stop = F.sum(seconds).over(Window.partitionBy(key).orderBy(order))
    return planned.withColumns({"stop": stop, "start": stop - F.col(seconds)})
