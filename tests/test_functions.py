"""Functions on inline fixtures, against plain Python where SQL has no word for them."""
import base64
import json
import math
import random

from pyspark.sql import functions as F

from feedloom.functions import chunks, config, text, urls
from feedloom.operators import analytics, digests, prompt, ranking, search, selection
from feedloom.operators.decompose import Finder, decompose


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_tokens_are_ascii_and_longer_than_two(spark):
    assert one(spark, text.tokens("v"), "Été ai code_2 C++ CI/CD the") == ["code_2", "the"]


def test_literal_terms(spark):
    assert one(spark, text.occurrences("v", "c++"), "c++ and c++11") == 2
    assert one(spark, text.word_occurrences("v", "agent"), "éagent agent agents") == 2


def test_boosts(spark):
    boost = lambda t, **k: one(spark, ranking.domain_boost(F.col("v"), **k), t)
    assert boost("nothing") == 1.0
    assert boost("a benchmark") == 1.5
    assert boost("an agent for code search") == 2.5
    assert boost("agent benchmark") == 1.5
    assert boost("benchmark evaluation") == 2.0
    assert boost("benchmark evaluation ai tooling") == 3.0
    assert boost("Acme here", highlight="acme") == 5.0
    for term in config.CORE_TERMS:
        assert boost(f"x {term} y") >= 1.5


def test_recency(spark):
    at = 1_000_000_000
    age = lambda days: one(spark, ranking.recency("v", at, 3.0), at - int(days * 86400), "long")
    assert age(3) == 0.5 and age(0) == 1.0 and age(-5) == 1.0 and age(100) == 0.2


def test_heuristics(spark):
    row = spark.createDataFrame([("marketing only",), ("agent planning and a paper",)], "v string").select(*[c.alias(n) for n, c in ranking.heuristic_scores(F.col("v")).items()]).collect()
    assert (row[0].relevance, row[0].tags) == (2.0, ["off-topic"])
    assert row[1].relevance == 5 + 1.0 + 0.5 and row[1].usefulness == 6.2 and row[1].tags == ["agent", "research"]


def test_first_and_latest_scores(spark):
    scores = spark.createDataFrame([(1, 10, 3.0), (1, 20, 9.0), (2, 5, 1.0)], "item_id long, scored_at long, relevance double")
    assert {r.item_id: r.relevance for r in ranking.first_scores(scores).collect()} == {1: 3.0, 2: 1.0}
    assert {r.item_id: r.relevance for r in ranking.latest_scores(scores).collect()} == {1: 9.0, 2: 1.0}


def greedy(rows, cap, most):
    """The selection as a loop: (id, source) by rank."""
    least, taken, count = selection.least_items(most), [], {}
    for i, s in rows:
        if count.get(s, 0) < cap and len(taken) < most:
            taken.append(i)
            count[s] = count.get(s, 0) + 1
    for i, _ in rows:
        if len(taken) < least and i not in taken:
            taken.append(i)
    return taken


def test_selection_equals_the_loop(spark):
    rng = random.Random(5)
    made, want = [], {}
    for case in range(60):
        n, sources, cap, most = rng.randint(0, 40), rng.randint(1, 8), 2, 12
        rows = [(i, f"s{rng.randint(1, sources)}") for i in range(n)]
        made += [(f"c{case}", i, s, i + 1) for i, s in rows]
        want[f"c{case}"] = greedy(rows, cap, most)
    got = {}
    frame = spark.createDataFrame(made, "category string, id long, source_title string, rank int")
    for r in selection.select_diverse(frame, 2, 12).orderBy("category", "position").collect():
        got.setdefault(r.category, []).append(r.id)
    assert got == {k: v for k, v in want.items() if v}


def test_ranks_in_ranges_equal_ranks_at_once(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, rng.choice("abc"), round(rng.random() * 20) / 20) for i in range(500)], "id long, category string, final double")
    plain = {r.id: r["rank"] for r in ranking.with_rank(rows, spread=1).collect()}
    assert {r.id: r["rank"] for r in ranking.with_rank(rows, spread=7).collect()} == plain
    assert {r.id for r in ranking.with_rank(rows, most=3).collect()} == {i for i, k in plain.items() if k <= 3}


def test_ranks_do_not_depend_on_how_often_ends_are_made(spark, monkeypatch):
    """Approximate percentiles may come out another way each time that they are made."""
    exact = F.percentile_approx
    moved = F.udf(lambda ends: [e + random.uniform(-0.02, 0.02) for e in ends], "array<double>").asNondeterministic()
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 997 / 997) for i in range(3000)], "id long, category string, final double").repartition(4)
    plain = {r.id: r["rank"] for r in ranking.with_rank(rows, spread=1).collect()}
    monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(exact(*a)))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # plans with joins don't reuse them
    try:
        assert {r.id: r["rank"] for r in ranking.with_rank(rows, spread=8).collect()} == plain
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_null_scores_rank_last_for_every_spread(spark):
    rng = random.Random(7)
    made = [(i, rng.choice("ab"), rng.choice([None, float("nan"), 0.5, 1.5, rng.random()])) for i in range(200)]
    rows = spark.createDataFrame([*made, (900, None, 1.0), (901, None, None)], "id long, category string, final double")
    found = [{r.id: r["rank"] for r in ranking.with_rank(rows, spread=k).collect()} for k in (1, 3, 8)]
    assert len(found[0]) == 202 and found[0] == found[1] == found[2]
    for c in "ab":
        mine = [(i, f) for i, x, f in made if x == c]
        none = {i for i, f in mine if f is None}
        assert {i for i in none if found[0][i] <= len(mine) - len(none)} == set()


def test_small_limits_still_give_ten():
    assert selection.least_items(5) == 10 and selection.least_items(30) == 21
    assert selection.source_cap(4, 10) == 4 and selection.source_cap(4, 25) == 10


def test_url_keys(spark):
    key = lambda u: one(spark, urls.url_key("v"), u)
    assert key("https://A.com:8080/x?q=1#f") == key("http://a.com/x") == "a.com/x"
    assert key("https://a.com") == "a.com/" and key("no url") is None and key(None) is None
    rows = spark.createDataFrame([(1, "https://a.com"), (2, "http://A.com/"), (3, "bad"), (4, "bad")], "id long, url string")
    assert sorted(r.id for r in selection.keep_first(rows, urls.url_key("url"), ["id"]).collect()) == [1, 3, 4]


def test_unwrapping(spark):
    coded = base64.urlsafe_b64encode(json.dumps({"e": "https://x.dev/ü?a=1"}).encode()).decode().rstrip("=")
    assert one(spark, urls.unwrap_base64("v"), f"https://substack.com/redirect/2/{coded}") == "https://x.dev/ü?a=1"
    assert one(spark, urls.unwrap_base64("v"), "https://substack.com/redirect/2/@@") == "https://substack.com/redirect/2/@@"
    assert Finder.unwrapped("https://t.example/CL0/https:%2F%2Fa.dev%2Fp%3Fx%3D1/1/abc") == "https://a.dev/p?x=1"


def test_review(spark):
    assert one(spark, text.ai_language_issues("v"), "We delve, delve.") == ['Overused AI word: "delve" (2x)']
    assert one(spark, text.bias_issues("v", "Acme"), "acme ACME Acme") == ["Over-mentions Acme (3x)"]
    assert one(spark, urls.bad_review_url("v"), "") and one(spark, urls.bad_review_url("v"), "https://a.com/sponsor")
    assert not one(spark, urls.bad_review_url("v"), "https://a.com/story")


def test_paper_urls(spark):
    url = lambda v, **k: one(spark, urls.arxiv_url("v", **k), v)
    assert url("2025arXiv251212730D") is None and url("2025arXiv2512345D") == "https://arxiv.org/abs/2512345.D"
    assert url("2025arXiv251212730D", fixed=True) == "https://arxiv.org/abs/2512.12730" and url("2025ApJ...1D", fixed=True) is None


def test_digests(spark):
    schema = "id long, title string, url string, source_title string, category string, summary string, tags array<string>, final double"
    rows = spark.createDataFrame([(1, "T", "https://a.dev", "S", "research", "<p>Short</p>", ["x", "y"], 0.64), (2, "U", "u", "S", "research", "word " * 60, ["a"] * 9, 1.25), (3, "V", "u", "S", "research", None, [], 0.0)], schema)
    got = {r.id: r for r in digests.fallback_digest(rows).collect()}
    assert got[1].gist == "Short" and got[1].why_it_matters == "From S. Topics: x, y" and got[1].key_bullets == ["Short"] and got[1].relevance == 6
    assert len(got[2].topic_tags) == 5 and got[2].why_it_matters.endswith("word...") and got[2].key_bullets[0].endswith("word...") and got[2].relevance == 13
    assert got[3].gist == "No summary available"
    cast = {r.id: r for r in digests.podcast_digest(rows, "agents").collect()}
    assert cast[1].one_line_takeaway == "Relevant to agents" and cast[3].key_facts == ["No summary available"]
    report = digests.verification_report(spark.createDataFrame([(1, "error", "fact", "a", "b", "c"), (1, "warning", "tone", "d", "e", "f"), (2, None, None, None, None, None)], "script long, severity string, type string, line string, issue string, fix string"), ["script"])
    text_of = {r.script: r.report for r in report.collect()}
    assert "### Errors (must fix)" in text_of[1] and "### Warnings" in text_of[1] and "No issues found." in text_of[2]


def test_transcripts(spark):
    clean = lambda t: one(spark, text.sanitize_transcript("v"), t)
    assert clean("HOST: [INTRO MUSIC] **Hi**  there [00:10] (≈5s)\n---\nCOHOST: yes") == "Hi there yes"
    assert one(spark, text.duration_seconds("v"), " ".join(["word"] * 100)) == 40
    assert one(spark, text.format_duration("v"), 3661, "long") == "1:01:01" and one(spark, text.format_duration("v"), 65, "long") == "1:05"
    assert chunks.turns_of("**HOST:** a\nHOST: b\nCOHOST: c") == [("HOST", "a b"), ("COHOST", "c")]
    assert chunks.turns_of("on localhost") == [("HOST", "on local")] and chunks.turns_of(None) == []


def test_chunks():
    long = ("word " * 300 + ". ") * 5
    assert "".join(chunks.cut_sentences(long)) == long and max(map(len, chunks.cut_sentences(long))) <= 2000
    assert chunks.cut_sentences("") == [""] and chunks.cut_speech("short") == ["short"]
    assert all(len(x) <= 3803 for x in chunks.cut_speech(long * 4))


def test_pseudo_embedding(spark):
    assert one(spark, search.pseudo_hash(F.col("v")), "hello") == 99162322
    vector = one(spark, search.pseudo_embedding(F.col("v")), "hello")
    assert len(vector) == 768 and abs(vector[3] - ((math.sin(99162322 + 3 * 73) * 0.5 + 0.5) * 2 - 1)) < 1e-6
    assert set(one(spark, search.pseudo_embedding(F.col("v")), "  ")) == {0.0}


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([-1.0, 0.0],), ([1.0],)], "embedding array<double>")
    assert [r.cosine for r in search.with_cosine(rows, [2.0, 0.0]).collect()] == [1.0, 0.0, -1.0, None]


def test_histogram_and_median(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert [r.n for r in analytics.histogram(rows, "x", 3).orderBy("bucket").collect()] == [1, 1, 2]
    assert analytics.upper_median(rows, "x").first().median == 3.0
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.n for r in analytics.histogram(same, "x", 2).orderBy("bucket").collect()] == [2, 0]
    assert [r.n for r in analytics.histogram(same.limit(0), "x", 2).orderBy("bucket").collect()] == [0, 0]


def test_prompts(spark):
    profile = prompt.prompt_profile("Focus on agents for the team: practical, avoid research")
    assert profile.focus_topics == ["research", "agents"] and profile.exclude_topics == ["research"]
    assert (profile.audience, profile.intent, profile.format_hints, profile.voice_style) == ("everyone", "focus", ["practical"], None)
    assert prompt.prompt_profile("  ") is None and prompt.prompt_profile("hello").focus_topics == []
    rows = spark.createDataFrame([(1, "agents", "", ["agents"], 1.0), (2, "x", "", ["x"], 1.0)], "id long, title string, summary string, tags array<string>, final double")
    assert [round(r.final, 6) for r in prompt.rerank(rows, ["agents"]).orderBy("id").collect()] == [8.0, 0.3]
    assert [r.id for r in prompt.exclude(rows, ["agent"]).collect()] == [2]


HTML = """<p>[First Post](https://a.dev/one) and [Sponsor](https://a.dev/two)</p>
<a href="https://t.example/CL0/https:%2F%2Fb.dev%2Fdeep/1/x"><strong>Deep</strong> dive</a>
<a href="https://c.dev/unsubscribe">Leave</a> <a href="https://a.dev/one">Again</a>"""


def test_decompose(spark):
    assert Finder().links(HTML)[:2] == [("First Post", "https://a.dev/one"), ("Deep dive", "https://b.dev/deep")]
    schema = "id string, source_title string, title string, url string, summary string, bm25 double, final double"
    rows = spark.createDataFrame([("n", "Letter X", "t", "u", HTML, 0.8, 0.9), ("o", "Blog", "t", "u", HTML, 0.8, 0.9), ("s", "Letter Y", "t", "u", 'see <a href="https://z.dev/p">Only one</a>', 0.8, 0.9), ("e", "Letter Z", "t", "u", "", 0.8, 0.9)], schema)
    got = {r.id: r for r in decompose(rows, ["Letter"]).collect()}
    assert round(got["n-article-1"].bm25, 6) == 0.76 and round(got["n-article-1"].final, 6) == 0.81
    assert got["o"].title == "t" and got["e"].url == "u"
    assert (got["s"].title, got["s"].final) == ("Only one", 0.9)


def test_words_of_reviews_are_found_in_one_pass(spark):
    """One pattern for all words, with the counts that a pass for each word gives."""
    rng = random.Random(3)
    parts = [*config.AI_WORDS, "delves", "un-delve", "_explore", "é", "shapes.", "Landscape"]
    rows = spark.createDataFrame([(k, " ".join(rng.choice(parts) for _ in range(40)) if k else None) for k in range(20)], "id long, v string")
    each = text.add([text.word_occurrences(F.lower("v"), w) for w in config.AI_WORDS])
    got = rows.select(F.size(text.found_words(F.lower("v"), config.AI_WORDS)), each).collect()
    assert all(a == b for a, b in got) and got[1][0] > 5
    plan = rows.select(text.ai_language_issues("v").alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("?<![A-Za-z0-9_]") == 1


def test_heuristic_score_looks_for_a_word_once(spark):
    rows = spark.createDataFrame([("code search of a codebase",), ("sales of sports",), (None,)], "v string")
    got = [tuple(r.h) for r in rows.select(ranking.heuristic_score(F.col("v")).alias("h")).collect()]
    assert got[1] == (2.0, 5.0, ["off-topic"]) and got[0][0] == 6.0 and "code-search" in got[0][2] and got[2][0] == 5.0
    plan = rows.select(ranking.heuristic_score(F.col("v")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sports") == 1
