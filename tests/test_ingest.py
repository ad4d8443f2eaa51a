"""Streaming ingest: marks, replays and merges."""
import json

from feedloom.sources import items as feeds
from feedloom.streaming import ingest

AS_OF = 1_767_225_600


def article(i, at, title="t", **more):
    return {"id": str(i), "title": title, "published": at, "categories": ["user/1/label/Papers"], "canonical": [{"href": f"https://x.dev/{i}"}], "summary": {"content": f"text {i}"}, "origin": {"streamId": "f", "title": "Feed"}} | more


def land(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def run(spark, tmp, check="check", **how):
    table = ingest.KeyedTable(spark, f"file://{tmp}/table", bucket_rows=4)
    query = ingest.ingest(spark, f"file://{tmp}/landing", table, f"file://{tmp}/{check}", AS_OF, {"Papers": "research"}, **how)
    query.awaitTermination()
    return {r.id: r for r in table.read().collect()}


def test_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    land(landing, "a.json", [article(1, AS_OF - 10), article(1, AS_OF - 5, "newer"), article(2, AS_OF - 90_000)])
    got = run(spark, tmp_path)
    assert set(got) == {"1"} and got["1"].title == "newer" and got["1"].category == "research" and got["1"].url == "https://x.dev/1"
    land(landing, "b.json", [article(3, AS_OF + 1), article(4, AS_OF - 7)])  # the second is not after the mark
    got = run(spark, tmp_path)
    assert set(got) == {"1", "3"}
    assert set(run(spark, tmp_path)) == {"1", "3"}  # nothing new


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    land(landing, "a.json", [article(i, AS_OF - i) for i in range(1, 9)])
    assert len(run(spark, tmp_path)) == 8
    land(landing, "b.json", [article(20, AS_OF + 5), article(3, AS_OF + 6, "again")])
    got = run(spark, tmp_path, "other")  # reads all files again; the mark keeps the new ones
    assert set(got) == {*map(str, range(1, 9)), "20"} and got["3"].title == "again"
    assert run(spark, tmp_path, "third", mark=0) == got  # a replay changes nothing


def test_only_touched_files_are_written(spark, tmp_path):
    table = ingest.KeyedTable(spark, f"file://{tmp_path}/t", bucket_rows=8)
    rows = lambda ids, v: spark.createDataFrame([(i, v, 1) for i in ids], "id string, v string, seq int")
    table.upsert(rows(map(str, range(60)), "old"), "seq")
    before = {f[1] for f in table.versions.latest()[1]["files"]}
    table.upsert(rows(["7"], "new"), "seq")
    after = {f[1] for f in table.versions.latest()[1]["files"]}
    assert len(before) >= 7 and len(before - after) == 1 and len(after - before) == 1
    assert {r.id: r.v for r in table.read().collect()} == {str(i): "new" if i == 7 else "old" for i in range(60)}
    table.upsert(rows([], "none"), "seq")
    assert table.read().count() == 60


def page(folder, n, rows):
    (folder / f"page={n}").mkdir(parents=True)
    land(folder / f"page={n}", "x.json", rows)


def paged(spark, tmp, name, as_of, **how):
    table = ingest.KeyedTable(spark, f"file://{tmp}/{name}", bucket_rows=50)
    return table, ingest.paged_sync(spark, f"file://{tmp}/landing", table, as_of, {"Papers": "research"}, **how)


def test_a_sync_stops_in_the_middle_and_goes_on(spark, tmp_path):
    for n in range(12):
        page(tmp_path / "landing", n, [article(10 * n + k, AS_OF - 10 * ((7 * n) % 12) - k) for k in range(5)])
    whole, state = paged(spark, tmp_path, "whole", AS_OF)
    assert state["status"] == "completed" and state["items"] == 60 and state["calls"] == 13
    table, state = paged(spark, tmp_path, "parts", AS_OF, most=6)
    assert state == {"cursor": 4, "mark": AS_OF - 86_400, "calls": 6, "day": "2026-01-01", "items": 25, "status": "paused"}
    assert table.read().count() == 25
    _, state = paged(spark, tmp_path, "parts", AS_OF + 3600, most=6)  # the same day: nothing is left to spend
    assert state["status"] == "paused" and state["cursor"] == 4 and table.read().count() == 25
    # A run that is lost before its commit takes nothing; its pages are taken again.
    lost = ingest.KeyedTable(spark, f"file://{tmp_path}/parts", bucket_rows=50)
    lost.versions.commit = lambda *_: 1 / 0
    try:
        ingest.paged_sync(spark, f"file://{tmp_path}/landing", lost, AS_OF + 86_400, {"Papers": "research"}, most=6)
    except ZeroDivisionError:
        pass
    assert table.state()["daily-sync"]["cursor"] == 4
    _, state = paged(spark, tmp_path, "parts", AS_OF + 86_400, most=6)
    assert state["cursor"] == 9 and state["status"] == "paused" and state["mark"] == AS_OF - 86_400
    _, state = paged(spark, tmp_path, "parts", AS_OF + 2 * 86_400, most=6)
    assert state["status"] == "completed" and state["items"] == 60
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, whole.read().collect()))
    page(tmp_path / "landing", 12, [article(500, AS_OF + 9), article(501, AS_OF - 500)])  # the next sync has a mark of its own
    _, state = paged(spark, tmp_path, "parts", AS_OF + 3 * 86_400, most=6)
    assert state["status"] == "completed" and state["items"] == 1 and state["cursor"] == 12
    assert paged(spark, tmp_path, "none", AS_OF, most=1)[1]["status"] == "paused"


def test_replace_mode_and_equal_times(spark, tmp_path):
    table = ingest.KeyedTable(spark, f"file://{tmp_path}/t")
    table.upsert(spark.createDataFrame([("a", "x", "y", 1)], "id string, v string, w string, seq int"), "seq")
    twice = [("a", "p", 2), ("a", "q", 2)]
    table.upsert(spark.createDataFrame(twice, "id string, v string, seq int"), "seq", "replace")
    first = table.read().collect()[0]
    table.upsert(spark.createDataFrame(twice[::-1], "id string, v string, seq int"), "seq", "replace")
    assert first.w is None and table.read().collect()[0].v == first.v  # equal times give the same row in any order


def test_budget():
    assert ingest.within_budget(94) and not ingest.within_budget(95)


def test_normalize(spark, tmp_path):
    land(tmp_path, "x.json", [article(1, 5, canonical=None, alternate=[{"href": "https://alt.dev", "type": "text/html"}]), article(2, 5, canonical=None, summary={"content": '<a href="https://in.agg.com/1">x</a><a href="https://good.dev">y</a>'}), {"id": "3"}])
    got = {r.id: r for r in feeds.normalize(feeds.read_feed(spark, f"file://{tmp_path}"), ("agg.com",)).collect()}
    assert got["1"].url == "https://alt.dev" and got["1"].categories == ["Papers"] and got["2"].url == "https://good.dev"
    assert got["3"].title == "Untitled" and got["3"].url == "" and got["3"].categories == []


def test_pages_that_share_a_folder_are_taken_page_by_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PAGES_A_FOLDER", 4)
    pages = {n: [article(10 * n + k, AS_OF - 10 * n - k) for k in range(5)] for n in range(12)}
    for k in range(2):  # pages 8 to 11 have a folder each
        (tmp_path / "landing" / f"pages={k}").mkdir(parents=True)
        land(tmp_path / "landing" / f"pages={k}", "x.json", [{**a, "page": n} for n in range(4 * k, 4 * k + 4) for a in pages[n]])
    for n in range(8, 12):
        page(tmp_path / "landing", n, pages[n])
    table, state = paged(spark, tmp_path, "parts", AS_OF, most=7)
    assert state["cursor"] == 5 and state["items"] == 30 and state["calls"] == 7 and state["status"] == "paused"
    _, state = paged(spark, tmp_path, "parts", AS_OF + 86_400, most=6)
    assert state["cursor"] == 10 and state["items"] == 55
    _, state = paged(spark, tmp_path, "parts", AS_OF + 2 * 86_400, most=6)
    assert state["status"] == "completed" and state["items"] == 60
    assert {r.id for r in table.read().collect()} == {str(10 * n + k) for n in pages for k in range(5)}
