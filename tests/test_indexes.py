"""Indexes and kept state against plain computations."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import analytics
from feedloom.operators.search import pseudo_embedding
from feedloom.sources.kept import ScoreState, VectorStore
from feedloom.sources.places import new_place
from feedloom.sources.term_index import TermIndex
from feedloom.sources.vector_index import VectorIndex

DAY = 86_400


def corpus(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "to", "x9_y", "rare"]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, [9, 5, 3, 1, 4, 1, 0.1], k=rng.randrange(40)))
        out.append((i, rng.choice(["a", "b", "c"]), 1000 * DAY + rng.randrange(9 * DAY), text if i % 17 else None))
    return out


def plain_bm25(rows, terms, since):
    docs = {i: (g, Counter(t for t in re.findall("[a-z0-9_]+", (x or "").lower()) if len(t) > 2)) for i, g, at, x in rows if at >= since}
    out = {}
    for i, (g, c) in docs.items():
        own = [d for h, d in docs.values() if h == g]
        avg, s = sum(sum(d.values()) for d in own) / len(own), 0.0
        for t in terms.get(g, []):
            df = sum(t in d for d in own)
            if c[t]:
                s += math.log((len(own) - df + 0.5) / (df + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))
        out[i] = (g, s)
    return out


@pytest.fixture(scope="module")
def index(spark):
    rows = corpus(random.Random(3), 400)
    made = TermIndex(spark, new_place(spark, "terms"), parts=4, block_docs=16)
    for part in (rows[:150], rows[150:151], rows[151:]):
        made.append(spark.createDataFrame(part, "id long, g string, at long, text string"), F.coalesce("text", F.lit("")), F.col("g"), F.col("at"))
    return made, rows


TERMS = {"a": ["alpha", "gamma", "alpha"], "b": ["rare", "to", "none"], "c": []}


@pytest.mark.parametrize("since", [0, 1004 * DAY + 12345])
def test_index_scores(index, since):
    made, rows = index
    want = plain_bm25(rows, TERMS, since)
    got = {r.id: (r.group, r.bm25_raw) for r in made.scores(TERMS, since).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == g and got[i][1] == pytest.approx(s, abs=1e-9) for i, (g, s) in want.items())


@pytest.mark.parametrize("k, since", [(1, 0), (5, 0), (7, 1005 * DAY + 777), (1000, 0)])
def test_index_top(index, k, since):
    made, rows = index
    want = plain_bm25(rows, TERMS, since)
    for g in "abc":
        best = sorted(((-round(s, 9), i) for i, (h, s) in want.items() if h == g and s > 0))[:k]
        got = made.top(TERMS, k, since).where(F.col("group") == g).collect()
        assert sorted((-round(r.bm25_raw, 9), r.id) for r in got) == best


def test_blocks_that_cannot_enter_are_left_out(spark):
    rows = [(i, "a", (i // 50) * DAY, "needle " * (20 if i == 777 else 1) + "hay " * 30) for i in range(1000)]
    made = TermIndex(spark, new_place(spark, "terms"), parts=2, block_docs=64)
    made.append(spark.createDataFrame(rows, "id long, g string, at long, text string"), F.col("text"), F.col("g"), F.col("at"))
    seen, scored = [], made._scored
    made._scored = lambda terms, blocks, *more: seen.append(blocks.count()) or scored(terms, blocks, *more)
    assert [r.id for r in made.top({"a": ["needle"]}, 1).collect()] == [777]
    assert made.bounds({"a": ["needle"]})[0].count() == 20 and seen == [1, 1]
    # Only the folders of a query's terms are read.
    files = made.postings(["needle"]).inputFiles()
    assert files and len({f.split("/part=")[1].split("/")[0] for f in files}) == 1 and made.postings(["nowhere", "hay"]).count() == 20


def test_exact_median(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randrange(50))) for _ in range(3001)] + [("b", 7.0)] * 2000 + [("b", 9.0)] * 2000 + [("c", rng.random()) for _ in range(2500)] + [("d", 1.0), ("d", 2.0), (None, 3.0), ("e", None)] + [("f", 1.0)] * 999 + [("f", rng.random()) for _ in range(1000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, v double")
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    want = {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    for fits in (1, 40, 10_000):
        assert {r.g: r.median for r in analytics.upper_median(table, "v", ["g"], fits).collect()} == want
    every = sorted(v for _, v in rows if v is not None)
    assert [r.median for r in analytics.upper_median(table, "v", (), 100).collect()] == [every[len(every) // 2]]
    assert analytics.upper_median(table.where("v > 100"), "v").collect() == []
    assert [r.median for r in analytics.upper_median(spark.range(100_001), "id", (), 500).collect()] == [50_000]


def test_score_state(spark):
    rng = random.Random(6)
    state = ScoreState(spark, new_place(spark, "state"), bucket_rows=20)
    rows, schema = [], "item_id long, scored_at long, relevance double, tags array<string>"
    for n in range(4):
        batch = [(rng.choice([None, *range(30)]), rng.randrange(50), rng.random(), ["t"] * rng.randrange(2)) for _ in range(40)]
        rows += batch
        table = spark.createDataFrame(batch, schema)
        assert state.append(table, "scores", n) and not state.append(table, "scores", n)
    history = spark.createDataFrame(rows, schema)
    assert state.history.read().count() == len(rows)
    for found, best in ((state.first(), min), (state.last(), max)):
        got = {r.item_id: r.scored_at for r in found.collect()}
        assert got == {i: best(at for j, at, *_ in rows if j == i) for i in {r[0] for r in rows}}
    from feedloom.operators.ranking import first_scores, latest_scores

    assert sorted(map(repr, state.first().collect())) == sorted(map(repr, first_scores(history).collect()))
    assert sorted(map(repr, state.last().collect())) == sorted(map(repr, latest_scores(history).collect()))
    # A run that is lost between the state and the history is made good by its replay.
    more, append = spark.createDataFrame([(1, 99, 0.5, [])], schema), state.history.append
    state.history.append = lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        state.append(more, "scores", 9)
    state.history.append = append
    assert state.append(more, "scores", 9) and state.history.read().where("scored_at = 99").count() == 1


def test_vectors_are_made_once(spark):
    store = VectorStore(spark, new_place(spark, "vectors"), lambda t: pseudo_embedding(t, 8))
    texts = [(i, f"text {i}") for i in range(30)] + [(99, None)]
    table = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    assert store.refresh(table(texts)) == 31 and store.refresh(table(texts)) == 0
    before = {r.item_id: r.embedding for r in store.read().collect()}
    texts[3] = (3, "changed")
    assert [r.item_id for r in store.missing(table(texts)).collect()] == [3]
    assert store.refresh(table([*texts, (100, "new")])) == 2
    after = {r.item_id: r.embedding for r in store.read().collect()}
    assert after[3] != before[3] and len(after) == 32 and all(after[i] == v for i, v in before.items() if i != 3)


@pytest.mark.parametrize("spread", [0.4, 100.0])
def test_vector_index(spark, spread):
    """Vectors around centers, and vectors without any structure."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 16))
    vectors = (centers[rng.integers(0, 20, 1500)] + spread * rng.normal(size=(1500, 16))).astype(np.float32)
    if spread < 1:
        vectors[:400] = vectors[0]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, [0.0] * 16), (2001, None), (2002, [1.0])]
    table = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(3)
    index = VectorIndex(spark, new_place(spark, "ivf"))
    index.build(table)
    queries = table.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"))
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)

    def exact(i):
        score = np.round(unit[i] @ unit.T, 9)
        return sorted(range(1500), key=lambda j: (-score[j], j))[:10]

    found = {}
    for r in index.search(queries, 10).collect():
        found.setdefault(r.query_id, []).append(r.item_id)
    hits = sum(len(set(found[i]) & set(exact(i))) for i in range(0, 1500, 50))
    assert hits / (30 * 10) >= 0.9
    probes, lists = (index.versions.latest()[1][n] for n in ("probes", "counts"))
    assert probes < len(lists) / 2 if spread < 1 else probes > len(lists) / 4
    whole = {}
    for r in index.search(queries, 10, probes=10**6).collect():
        whole.setdefault(r.query_id, []).append(r.item_id)
    assert all(sorted(whole[i]) == sorted(exact(i)) for i in range(0, 1500, 50))


def test_trigram_index(spark):
    from feedloom.operators.search import search_keyword
    from feedloom.sources.text_index import TextIndex

    rng = random.Random(12)
    words = ["lorem", "ipsum", "dolor", "Sit", "amet", "é", "日本語"]
    rows = [(i, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=20)) if i % 9 else None) for i in range(900)]
    rows[333] = (333, "a Needle here", "x")
    rows[700] = (700, None, "haystack NEEDLES 日本酒")
    table = spark.createDataFrame(rows, "id long, title string, summary string")
    index = TextIndex(spark, new_place(spark, "grams"), block_docs=16, shelf_blocks=4)
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    index.append(table.where("id < 500"), text)
    index.append(table.where("id >= 500"), text)

    def same(query, terms):
        want = sorted(map(tuple, search_keyword(table, query, 900).select("id", "score").collect()))
        found = index.candidates(terms)
        assert sorted(map(tuple, search_keyword(found, query, 900).select("id", "score").collect())) == want
        return found.count()

    assert same("needle", ["needle"]) <= 32 and same("needle 日本酒", ["needle", "日本酒"]) <= 32
    assert same("nowhere", ["nowhere"]) == 0 and same("ipsum", ["ipsum"]) == 900
    assert same("é needle", ["é", "needle"]) == 900  # a term of two bytes prunes nothing
    plan = index.candidates(["needle"])
    assert {r[0] for r in plan.select("id").where("title = 'a Needle here'").collect()} == {333}
    assert "shelf" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_recall_on_the_tables(spark):
    """The registered query against the whole scan."""
    from feedloom.plans.registry import QUERIES

    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit, found = v / np.linalg.norm(v, axis=1, keepdims=True), {}
    for r in QUERIES["vec_index_search"](spark, data).collect():
        found.setdefault(r.query_id, set()).add(r.item_id)
    asked = [q for q in range(len(ids)) if ids[q] % 50 == 0]
    assert set(found) == {ids[q] for q in asked}
    hits = sum(len(found[ids[q]] & set(ids[np.lexsort((ids, -np.round(unit @ unit[q], 9)))[:10]])) for q in asked)
    assert hits / (10 * len(asked)) >= 0.9


def test_tokens_are_counted_in_portions():
    """A batch of many documents comes back as several small ones, with the same counts."""
    import pyarrow as pa

    from feedloom.sources import term_index

    n = 2 * term_index.COUNTED + 7
    ids, ones = pa.array(range(n)), pa.array([1] * n)
    lists = pa.array([["a", "b", "a", f"w{k % 3}"][: k % 5] for k in range(n)])
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["g"] * n), ones, ones, ones, pa.array([k % 5 for k in range(n)]), lists], names=["id", "group", "at", "day", "shard", "dl", "t"])
    out = list(term_index._counted("long")[0](iter([batch])))
    assert max(len(set(b.column(0).to_pylist())) for b in out) <= term_index.COUNTED and len(out) == 3
    got = {(r["id"], r["term"]): r["tf"] for b in out for r in b.to_pylist()}
    want = {}
    for k, words in enumerate(lists.to_pylist()):
        for w in words:
            want[k, w] = want.get((k, w), 0) + 1
    assert got == want


def test_batches_of_texts_are_bounded(spark):
    from feedloom.functions import chunks
    from feedloom.operators.decompose import decompose

    rows = spark.createDataFrame([], "id string, source_title string, title string, url string, summary string, bm25 double, final double")
    for made in (chunks.chunk_sentences, chunks.chunk_speech, chunks.speaker_turns, lambda: decompose(rows, ["x"])):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        made()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= chunks.BATCH_ROWS
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= chunks.BATCH_BYTES
