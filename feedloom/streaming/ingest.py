"""Incremental ingest with Structured Streaming.

Landed feed pages are read as a file stream; every micro-batch is normalised,
filtered by the high-water mark of the run and upserted by id into a table with
snapshots, which rewrites the files that hold one of the batch's keys only.  An
upsert of the same rows changes nothing, so a batch that is replayed, after a
failure or with a new checkpoint, does no harm.  The streaming checkpoint takes
the place of a stored cursor; a sync with a budget of calls keeps its cursor in
the table itself, committed with the rows of the pages that it stands for.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedloom.sources import items as feeds
from feedloom.sources.versions import SnapshotTable

DAY = 86_400


class KeyedTable(SnapshotTable):
    """A table of items by id."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", bucket_rows: int = 1 << 20) -> None:
        super().__init__(spark, path, [key], bucket_rows)


#: Columns of an empty batch.
ITEM_SCHEMA = "id string, stream_id string, source_title string, title string, url string, author string, published_at long, summary string, content_snippet string, categories array<string>, category string, __seq long"


def high_water(table: DataFrame | None, as_of: int, empty_days: int = 1, catch_up_days: int | None = None) -> int:
    """The newest time in the table; a day ago if it is empty; `catch_up_days` ago if asked for."""
    if catch_up_days is not None:
        return as_of - catch_up_days * DAY
    newest = table.agg(F.max("published_at")).first()[0] if table is not None else None
    return as_of - empty_days * DAY if newest is None else newest


def newer(rows: DataFrame, mark: int, inclusive: bool = False) -> DataFrame:
    """Rows after the mark: late rows are dropped, with no tolerance."""
    return rows.where(F.col("published_at") >= mark) if inclusive else rows.where(F.col("published_at") > mark)


def upsert_batch(table: KeyedTable, mark: int, prepare: Callable[[DataFrame], DataFrame], mode: str = "merge", inclusive: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: what is after the mark goes into the table."""

    def run(batch: DataFrame, number: int) -> None:
        rows = newer(prepare(batch), mark, inclusive).withColumn("__seq", F.col("published_at")).persist()  # read for its buckets, its keys and its rows
        try:
            table.upsert(rows, "__seq", mode)
        finally:
            rows.unpersist()

    return run


def _prepared(folders: dict[str, str], streams: tuple[str, ...] | None):
    def prepare(rows: DataFrame) -> DataFrame:
        made = feeds.categorize(feeds.normalize(rows), folders)
        return made if streams is None else made.where(F.col("stream_id").isin(list(streams)))

    return prepare


def ingest(spark: SparkSession, landing: str, table: KeyedTable, checkpoint: str, as_of: int, folders: dict[str, str], mode: str = "merge", mark: int | None = None,
           catch_up_days: int | None = None, files_a_batch: int = 8, streams: tuple[str, ...] | None = None) -> StreamingQuery:
    """Read what has landed since the last run, and stop.  The mark is taken once for
    a run; `streams` keeps the articles of some streams only."""
    mark = high_water(table.read(), as_of, catch_up_days=catch_up_days) if mark is None else mark
    stream = feeds.stream_feed(spark, landing, files_a_batch)
    run = upsert_batch(table, mark, _prepared(folders, streams), mode)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def within_budget(calls_used: int, most: int = 95) -> bool:
    """Whether a run may make another call today; runs pause at `most` calls."""
    return calls_used < most


def daily_sync(spark: SparkSession, landing: str, table: KeyedTable, checkpoint: str, as_of: int, folders: dict[str, str], calls_used: int = 0, **how) -> bool:
    """Articles after the newest one that the table has; False if the budget pauses it."""
    if not within_budget(calls_used):
        return False
    ingest(spark, landing, table, checkpoint, as_of, folders, **how).awaitTermination()
    return True


PAGE = "page"
#: Folders of many pages, so that files follow the bytes landed, not the pages: folder K has
#: pages from K * PAGES_A_FOLDER on, and each of its articles has its page's number.
PAGES = "pages"
PAGES_A_FOLDER = 256
_NUMBERED = T.StructType([*feeds.FEED_ARTICLE, T.StructField(PAGE, T.IntegerType())])


def _folders(spark: SparkSession, landing: str) -> dict[str, list[int]]:
    """Numbers of the folders that have landed, of one page each and of many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(landing)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {kind: sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{kind}=")) for kind in (PAGE, PAGES)}


def landed_pages(spark: SparkSession, landing: str, after: int = -1) -> list[int]:
    """Numbers of the pages that have landed and come after `after`, in order."""
    found = _folders(spark, landing)
    out = {p for p in found[PAGE] if p > after}
    many = [f"{landing}/{PAGES}={k}" for k in found[PAGES] if (k + 1) * PAGES_A_FOLDER > after + 1]
    if many:
        rows = spark.read.schema(T.StructType([_NUMBERED[PAGE]])).json(many).where(F.col(PAGE) > after)
        out |= {r[0] for r in rows.distinct().collect()}  # a number a page
    return sorted(out)


def _read_pages(spark: SparkSession, landing: str, taken: list[int]) -> DataFrame:
    """Articles of pages that follow each other in what has landed; other folders are not read."""
    found, wanted = _folders(spark, landing), set(taken)
    one = [f"{landing}/{PAGE}={p}" for p in found[PAGE] if p in wanted]
    many = [f"{landing}/{PAGES}={k}" for k in found[PAGES] if k in {p // PAGES_A_FOLDER for p in wanted}]
    parts = [spark.read.schema(feeds.FEED_ARTICLE).json(one)] if one else []
    if many:
        parts.append(spark.read.schema(_NUMBERED).json(many).where(F.col(PAGE).between(taken[0], taken[-1])).drop(PAGE))
    return reduce(DataFrame.unionByName, parts)


def paged_sync(spark: SparkSession, landing: str, table: KeyedTable, as_of: int, folders: dict[str, str], name: str = "daily-sync", most: int = 95, mode: str = "merge", catch_up_days: int | None = None) -> dict:
    """A sync that takes one call for its start and one for each page, and stops in the
    middle when the calls of the UTC day reach `most`; the next run goes on after the
    last page that it took, with the same high-water mark, so runs in pieces take what
    one run takes.  The state (cursor, mark, calls, day, items, status) is committed with
    the pages' rows, so a run that is lost has taken all of its pages or none.

    All pages of a run are one batch: which pages it may take follows from the state,
    and only folders that hold some of them are read.  Pages have a folder each, or share one.
    """
    day = time.strftime("%Y-%m-%d", time.gmtime(as_of))
    old = table.state().get(name)
    going = old is not None and old["status"] == "paused"
    used = old["calls"] if old is not None and old["day"] == day else 0
    mark = old["mark"] if going else high_water(table.read(), as_of, catch_up_days=catch_up_days)
    cursor = old["cursor"] if old is not None else -1
    left = landed_pages(spark, landing, cursor)
    can = max(0, most - used - 1)
    if not left or not can:
        state = {"cursor": cursor, "mark": mark, "calls": used, "day": day, "items": old["items"] if going else 0, "status": "paused" if left else "completed"}
        if old is not None or left:
            table.upsert(spark.createDataFrame([], ITEM_SCHEMA), "__seq", mode, state={name: state})
        return state
    taken = left[:can]
    pages = _read_pages(spark, landing, taken)
    rows = newer(_prepared(folders, None)(pages), mark).withColumn("__seq", F.col("published_at")).persist()
    try:
        items = rows.count() + (old["items"] if going else 0)
        state = {"cursor": taken[-1], "mark": mark, "calls": used + 1 + len(taken), "day": day, "items": items, "status": "paused" if len(taken) < len(left) else "completed"}
        table.upsert(rows, "__seq", mode, state={name: state})
    finally:
        rows.unpersist()
    return state


def weekly_sync(spark: SparkSession, landing: str, table: KeyedTable, checkpoint: str, as_of: int, folders: dict[str, str], calls_used: int = 0, **how) -> bool:
    """Articles of the last seven days, whatever the table has; False if the budget pauses it."""
    return daily_sync(spark, landing, table, checkpoint, as_of, folders, calls_used, mark=as_of - 7 * DAY, **how)


def recent_sync(spark: SparkSession, landing: str, table: KeyedTable, as_of: int, folders: dict[str, str], hours: int = 48, streams: tuple[str, ...] | None = None, mode: str = "merge") -> None:
    """All that has landed of the last hours, the first moment included, in one batch without a checkpoint."""
    rows = feeds.read_feed(spark, landing)
    upsert_batch(table, as_of - hours * 3600, _prepared(folders, streams), mode, inclusive=True)(rows, 0)


def stream_sync(spark: SparkSession, landing: str, table: KeyedTable, folders: dict[str, str], streams: tuple[str, ...] | None = None, mode: str = "replace") -> None:
    """All that has landed of some streams (a category's, a label's, one, or all), whatever its time."""
    upsert_batch(table, -(1 << 62), _prepared(folders, streams), mode, inclusive=True)(feeds.read_feed(spark, landing), 0)


def label_sync(spark: SparkSession, landing: str, table: KeyedTable, folders: dict[str, str], label: str, mode: str = "replace") -> None:
    """All that has landed under a label, whatever its time."""
    prepare = _prepared(folders, None)
    upsert_batch(table, -(1 << 62), lambda rows: prepare(rows).where(F.array_contains("categories", label)), mode, inclusive=True)(feeds.read_feed(spark, landing), 0)


def deduplicated(stream: DataFrame, key: str = "id", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """An improvement on zero tolerance: rows up to `delay` late count, each key once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def calls_a_day(stream: DataFrame, time: str = "ts", delay: str = "2 days") -> DataFrame:
    """The budget counter: rows of each UTC day."""
    days = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("used"))
    return days.select(F.col("w.start").alias("day"), "used")
