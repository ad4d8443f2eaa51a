"""Snapshot tables: atomic writes, replays, growth, and the term index on top."""
import random

import pytest
from pyspark.sql import functions as F

from feedloom.sources import upserts
from feedloom.sources.places import new_place
from feedloom.sources.versions import Conflict, SnapshotTable, Versions, bucket_of, split_from

SCHEMA = "id long, title string, body long"


def rows_of(df):
    return sorted(map(tuple, df.select("id", "title", "body").collect()), key=repr)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", seq int")


def test_a_writer_lost_before_its_manifest_leaves_the_old_snapshot(spark, monkeypatch):
    table = SnapshotTable(spark, new_place(spark, "t"))
    assert table.read() is None and not table.exists()
    table.upsert(batch(spark, [(1, "a", 1, 0), (2, "b", 2, 0), (None, "n", 0, 0)]), "seq")
    before = rows_of(table.read())

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table.versions, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(batch(spark, [(1, "x", 9, 0), (3, "c", 3, 0)]), "seq")
    assert rows_of(table.read()) == before and table.versions.numbers() == [1]
    table.upsert(batch(spark, [(1, "x", None, 0), (3, "c", 3, 0), (None, None, 5, 0)]), "seq")
    assert rows_of(table.read()) == sorted([(1, "x", 1), (2, "b", 2), (3, "c", 3), (None, "n", 5)], key=repr)
    assert rows_of(table.read(1)) == before
    assert table.vacuum(1) >= 2  # the lost writer's folder, and what the old version alone named
    assert len(rows_of(table.read())) == 4 and table.versions.numbers() == [2]


def test_versions_are_committed_once(spark):
    path = new_place(spark, "v")
    a, b = Versions(spark, path), Versions(spark, path)
    assert a.latest() == (0, None)
    a.commit(1, {"x": 1})
    with pytest.raises(Conflict):
        b.commit(1, {"x": 2})
    assert b.latest() == (1, {"x": 1}) and b.numbers() == [1]


def test_batches_of_a_writer_count_once(spark):
    log = SnapshotTable(spark, new_place(spark, "log"), ["id"])
    one, two = batch(spark, [(1, "a", 1, 0)]).drop("seq"), batch(spark, [(1, "a", 1, 0), (2, "b", 2, 0)]).drop("seq")
    assert log.append(one, "scores", 0) and log.append(two, "scores", 1)
    assert not log.append(two, "scores", 1) and not log.append(one, "scores", 0)
    assert log.append(one, "other", 0) and log.append(one)
    assert log.read().count() == 5 and log.applied("scores") == 1 and log.applied("nobody") == -1
    with pytest.raises(ValueError):
        log.append(one, "scores")


@pytest.mark.parametrize("mode", ["merge", "replace", "ignore"])
def test_upserts_equal_whole_table_transforms(spark, mode):
    """Many small batches, with null keys, repeats and buckets that split on the way."""
    rng = random.Random(4)
    table = SnapshotTable(spark, new_place(spark, "u"), bucket_rows=40, most_files=3)
    plain = spark.createDataFrame([], SCHEMA)
    for k in range(7):
        rows = [(rng.choice([None, *range(150)]), rng.choice([None, f"t{k}"]), rng.choice([None, k]), s) for s in range(rng.randrange(1, 60))]
        new = batch(spark, rows)
        table.upsert(new, "seq", mode)
        if mode == "merge":
            plain = upserts.merge(plain, new, ["id"], "seq", ["title", "body"])
        else:
            plain = (upserts.replace if mode == "replace" else upserts.insert_ignore)(plain, new, ["id"], "seq")
        plain = spark.createDataFrame(plain.collect(), SCHEMA)
        assert rows_of(table.read()) == rows_of(plain)
        was = rows_of(table.read())
        table.upsert(new, "seq", mode)  # a replay changes nothing
        assert rows_of(table.read()) == was
    assert table.last["buckets"] > 2


def test_what_is_rewritten_follows_the_batch(spark):
    """Ten keys rewrite about as many files in a table of four times the size."""
    touched = []
    for n in (4_000, 16_000):
        table = SnapshotTable(spark, new_place(spark, "w"), bucket_rows=100)
        table.upsert(spark.range(n).select("id", F.lit("a").alias("title"), F.lit(1).cast("long").alias("body"), F.lit(0).alias("seq")), "seq")
        files = len(table.versions.latest()[1]["files"])
        table.upsert(batch(spark, [(7 * k, "b", 2, 0) for k in range(10)]), "seq")
        touched.append(table.last["retired"])
        assert files >= n // 200 and table.last["retired"] <= 10 + 1  # and a bucket that splits
        table.upsert(batch(spark, [(10**9 + k, "new", 2, 0) for k in range(10)]), "seq")
        assert table.last["retired"] <= 1 + 1  # new keys rewrite nothing but a bucket that splits
    assert abs(touched[0] - touched[1]) <= 4


def test_linear_hash(spark):
    keys = spark.range(3000)
    for old, new in ((1, 2), (2, 3), (3, 8), (5, 6), (8, 13)):
        rows = keys.select(bucket_of(["id"], old).alias("a"), bucket_of(["id"], new).alias("b")).distinct().collect()
        assert {r.b for r in rows} == set(range(new))
        assert {r.a for r in rows if r.b >= old} == split_from(old, new)
        assert all(r.a == r.b for r in rows if r.b < old)


def test_ratings(spark):
    from feedloom.sources.ratings import Ratings, feeds_of

    ratings = Ratings(spark, new_place(spark, "ratings"))
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    assert {tuple(r) for r in ratings.of(ids).collect()} == {(i, None, None, None, False) for i in "abc"}
    with pytest.raises(ValueError):
        ratings.rate(spark.createDataFrame([("a", 4, "", 1, 0)], "item_id string, rating int, notes string, rated_at long, seq int"))
    ratings.star(spark.createDataFrame([("a", True, 0), ("b", True, 0), ("b", False, 1)], "item_id string, starred boolean, seq int"))
    ratings.rate(spark.createDataFrame([("a", 3, "good", 1, 0), ("b", 0, None, 2, 0)], "item_id string, rating int, notes string, rated_at long, seq int"))
    assert sorted(map(tuple, ratings.of(ids).collect())) == [("a", 3, "good", 1, True), ("b", 0, None, 2, False), ("c", None, None, None, False)]
    assert ratings.source_factors(spark.createDataFrame([("f",)], "stream_id string")).first().factor == 1.0
    rows = spark.createDataFrame([("s", "T", "https://H.com:8/x", ["RESEARCH", "x"]), ("t", "U", None, [])], "stream_id string, title string, html_url string, labels array<string>")
    assert sorted(map(tuple, feeds_of(rows, {"research": "research"}).collect())) == [("s", "T", "research", ["RESEARCH", "x"], "h.com"), ("t", "U", "newsletters", [], None)]


def test_long_rows_are_dealt_into_more_buckets(spark, tmp_path):
    """A bucket has a bound in bytes, so no task writes a whole table of long texts."""
    table = SnapshotTable(spark, f"{tmp_path}/long", bucket_bytes=1 << 16)
    rows = spark.range(400).select(F.col("id"), F.repeat(F.lit("x"), 2000).alias("text"), F.lit(1).alias("seq"))
    for _ in range(2):  # a replay changes no row
        table.upsert(rows, "seq")
        files = table.versions.latest()[1]["files"]
        assert len({bucket for bucket, _, _ in files}) >= 8 and max(n for _, _, n in files) <= 100
        assert sorted(r.id for r in table.read().collect()) == list(range(400))
