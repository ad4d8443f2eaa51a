"""Episodes, reviews and replies on inline fixtures."""
import random
import re

import pytest

from feedloom.functions import chunks, urls
from feedloom.operators import digests, podcast, replies

TEXT = "Intro (ref: item-9)\n## SEGMENT: One\n- A first point made (ref: item-0)\nplain (ref: item-0) (ref: item-2)\n—\n- short\n## SEGMENT:\nTwo\nwords"


def test_segments(spark):
    rows = podcast.segments(spark.createDataFrame([("e", TEXT), ("w", "no marks here (ref: item-1)"), ("n", None)], "id string, script string")).collect()
    got = {(r.id, r.n): r for r in rows}
    one, two, whole = got["e", 0], got["e", 1], got["w", 0]
    assert one.title == "One" and one.refs == [0, 2] and one.highlights == ["A first point made"] and one.start == 0
    count = lambda t: len(re.split(r"\s+", t))
    body = TEXT.split("## SEGMENT: ")[1].split("## SEGMENT:")[0].split("\n", 1)[1]
    assert one.duration == -(-count(body) * 60 // 150) and two.start == one.stop and two.title == "Two"
    assert whole.title == "Full Episode" and whole.start_time == "0:00" and whole.refs == [1] and whole.highlights == []


def test_references(spark):
    found = podcast.segments(spark.createDataFrame([("e", TEXT)], "id string, script string"))
    items = spark.createDataFrame([("e", 0, "i0", "T", "u", "s")], "id string, position int, item_id string, title string, url string, source_title string")
    assert sorted((r.n, r.ref, r.item_id, r.title, r.url) for r in podcast.referenced(found, items).collect()) == [(0, 0, "i0", "T", "u"), (0, 2, "item-2", "Unknown", "#")]


def test_rundown_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "a" if i < 200 else "b", i % 7) for i in range(205)], "id long, g string, score int")
    got = podcast.rundown(rows, ["g"], ["score", "id"]).collect()
    assert len(got) == 205
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.score, r.id))
        assert [r.band for r in mine] == ["segment"] * 4 + ["lightning"] * min(3, len(mine) - 4) + ["cut"] * max(0, len(mine) - 7)
        assert [r.seconds for r in mine[:5]] == [120] * 4 + [0]


def test_script_times(spark):
    planned = spark.createDataFrame([("e", 1, 120), ("e", 2, 60)], "k string, place int, seconds int")
    spoken = spark.createDataFrame([("e", 241)], "k string, spoken long")
    assert [(r.start, r.stop, r.duration) for r in podcast.script_times(planned, spoken, "k").orderBy("place").collect()] == [(30, 151, 121), (151, 211, 60)]


def test_fixes_go_in_order(spark):
    scripts = spark.createDataFrame([(1, "It is so. It is so. Surely."), (2, "Fine."), (3, "A. B.")], "id long, script string")
    issues = spark.createDataFrame([
        (1, 1, "error", "unsupported_claim", "It is so.", ""), (1, 2, "error", "unsupported_claim", "Surely.", ""), (1, 3, "warning", "overconfident_language", "Surely.", "Perhaps."),
        (3, 1, "warning", "overconfident_language", "not there", "x"), (3, 2, "warning", "overconfident_language", "B.", ""), (3, 3, "warning", "unsupported_claim", "A.", ""),
    ], "id long, n int, severity string, type string, line string, fix string")
    got = {r.id: r.script for r in digests.apply_fixes(scripts, issues, "id", "n").collect()}
    assert got == {1: "It is so. [NEEDS SUPPORT] It is so. Perhaps.", 2: "Fine.", 3: "A. B."}


def digest(**own):
    return {"id": "1", "title": "T", "url": "https://a.dev/x", "gist": "Fine.", "why_it_matters": "It saves time.", "key_bullets": ["Good.", "Better."]} | own


@pytest.mark.parametrize("own, starts", [
    ({}, []), ({"url": ""}, ["Bad URL domain/pattern: "]), ({"url": "https://x.com/sponsor/a"}, ["Bad URL domain/pattern: https://x.com/sponsor/a"]),
    ({"gist": "They delve in."}, ['Gist has AI language: Overused AI word: "delve" (1x)']), ({"why_it_matters": "Teams should explore it."}, ["Why It Matters has AI language", "Why It Matters: Generic"]),
    ({"key_bullets": ["ok", "We delve.", "They showcase."]}, ["Key bullet has AI language: We delve...."]), ({"gist": "We delved."}, []),
])
def test_review(spark, own, starts):
    frame = spark.createDataFrame([digest(**own)], "id string, title string, url string, gist string, why_it_matters string, key_bullets array<string>")
    row = digests.review(frame).collect()[0]
    assert len(row.issues) == len(starts) and all(i.startswith(s) for i, s in zip(row.issues, starts)) and row.passed == (not starts)


def test_podcast_review(spark):
    schema = "id string, url string, one_sentence_gist string, one_line_takeaway string, soundbite_lines array<string>, relevance_to_focus int"
    rows = [("1", "https://a.dev/x", "fine", "fine", ["fine"], None), ("2", None, "Shapeshifting landscapes", "ok", ["x", "DELVES"], 2), ("3", "https://a.dev/subscribed", "ok", "ok", [], 3), ("4", "https://a.dev/subscribe", "ok", "ok", [], 9)]
    got = {r.id: r.issues for r in digests.review_podcast(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"] == [] and got["3"] == [] and got["4"] == ["Bad URL: https://a.dev/subscribe"]
    assert got["2"] == ["Bad URL: ", "Gist contains AI-style language", "Soundbite contains AI-style language", "Low relevance score: 2"]


def test_batch_replies(spark):
    ok = 'x [{"relevance": 0, "usefulness": 12, "tags": ["a"]}, {"relevance": -3, "tags": "no"}] y'
    rows = [([1, 2], ok), ([3, 4], "[1]"), ([5], None), ([6], "[{]"), ([7, 8, 9], ok)]
    got = {r.id: (r.relevance, r.usefulness, r.tags) for r in replies.batch_scores(spark.createDataFrame(rows, "ids array<int>, reply string")).collect()}
    assert got[1] == (5.0, 10.0, ["a"]) and got[2][:2] == (0.0, 5.0)
    assert all(got[k] == (5.0, 5.0, []) for k in (3, 4, 5, 6, 7, 8, 9)) and len(got) == 9


def test_found_urls(spark):
    rows = [("see https://tracking.x.com/a and (https://good.dev/p?q=1), then https://other.dev",), ("none",), ("https://reddit.com/r/a",), (None,)]
    got = [r.u for r in spark.createDataFrame(rows, "t string").select(urls.first_url("t").alias("u")).collect()]
    assert got == ["https://good.dev/p?q=1", None, None, None]


def plain_sentences(text, size=2000):
    out, left = [], text
    if len(text) <= size:
        return [text]
    while left:
        piece = left[:size]
        stop = piece.rfind(".")
        if size * 0.7 < stop < len(piece) - 1:
            piece = piece[: stop + 1]
        out.append(piece)
        left = left[len(piece) :]
    return out


def test_chunks_are_whole_and_bounded():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices("ab .\n-", [8, 8, 3, 1, 1, 1], k=rng.randint(0, 9000)))
        cut = chunks.cut_sentences(text)
        assert "".join(cut) == text and all(len(c) <= 2000 for c in cut)
        if len(text) > 2000:
            assert cut == plain_sentences(text)
        speech = chunks.cut_speech(text)
        assert all(len(c) <= 3800 + 3 for c in speech) and re.sub(r"\s", "", "".join(speech)) == re.sub(r"\s", "", text)


def test_turns_by_a_plain_scan():
    rng = random.Random(4)
    for _ in range(200):
        parts = [(rng.choice(["HOST", "COHOST"]), " ".join(rng.choices(["red", "green", "blue"], k=rng.randint(1, 4)))) for _ in range(rng.randint(1, 8))]
        text = "\n".join(f"{rng.choice(['**', ''])}{s}: {t}".replace("**HOST:", "**HOST:**").replace("**COHOST:", "**COHOST:**") for s, t in parts)
        want = []
        for s, t in parts:
            if want and want[-1][0] == s:
                want[-1] = (s, f"{want[-1][1]} {t}")
            else:
                want.append((s, t))
        assert chunks.turns_of(text) == want


def test_an_issue_has_all_its_digests(spark):
    """More digests than fifty, of one category and of two."""
    from feedloom.operators import render

    made = [("i", "research" if n % 2 else "podcasts", n % 7, f"t{n:03d}", "u", "s", "g", ["b"]) for n in range(130)]
    rows = spark.createDataFrame(made, "issue string, category string, relevance long, title string, url string, source_title string, gist string, key_bullets array<string>")
    for html, mark in ((False, r"### \[(t\d+)\]"), (True, r">(t\d+)</a>")):
        body = render.newsletter(rows, "issue", "Weekly", html=html).first().body
        want = sorted(made, key=lambda r: (r[1] == "podcasts", -r[2], r[3]))
        assert re.findall(mark, body) == [r[3] for r in want]
