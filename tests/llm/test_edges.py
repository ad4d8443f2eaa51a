"""Edges: ties of rules, curves, and the pipeline on odd tables."""
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from feedloom.llm import quality, toxicity, url_filter

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
BENCH = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


@pytest.fixture
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def folder(path, docs, labels=(), bench=(), extra=None):
    docs = pa.Table.from_pylist([dict(zip(DOCS.names, r)) for r in docs], schema=DOCS)
    if extra:
        for name in extra:
            docs = docs.append_column(name, pa.array(["x"] * len(docs), pa.string()))
    pq.write_table(docs, path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(LABELS.names, r)) for r in labels], schema=LABELS), path / "labels.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(BENCH.names, r)) for r in bench], schema=BENCH), path / "benchmark.parquet")
    return f"file://{path}"


def test_pipeline_on_empty_tables(spark, pipeline, tmp_path):
    out = pipeline.run(spark, folder(tmp_path, []))
    assert out.collect() == [] and "token_ids" in out.columns


def test_pipeline_on_odd_rows(spark, pipeline, tmp_path):
    """Without labels or a benchmark; null ids and texts, repeated ids and rows, extra and clashing columns, one very long text."""
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, "a text of its own that nothing repeats", "en", "s", 5), (1, "another text under the same id as before", "en", "s", 5), (2, None, None, None, None), (None, "a row without an id but with some words", "de", "s", 1),
            (3, "", "en", "s", 0), (4, long, "en", "s", len(long)), (5, "a text of its own that nothing repeats", "en", "s", 5)]
    out = pipeline.run(spark, folder(tmp_path, rows, extra=["toxic", "score", "token_ids", "hash"])).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(1) == 2 and 5 not in ids and None in ids and 4 in ids
    assert next(r for r in out if r.doc_id == 4).n_tokens > 60_000


def test_equal_rules(spark):
    """Of fitting rules of equal length the one with the longer host wins."""
    rules = [("allow", "bc", "/de"), ("block", "a.bc", "/d")]
    pages = spark.createDataFrame([(1, "http://a.bc/de/x"), (1, "http://a.bc/de/x"), (2, "http://q.bc/de")], "page_id long, url string")
    for order in (rules, rules[::-1]):
        got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, order).collect())
        assert got == [(1, "a.bc/d", "block"), (1, "a.bc/d", "block"), (2, "bc/de", "allow")]


def test_curve_is_the_best_fit():
    """The slope and offset lie where the penalised likelihood is least."""
    rng = np.random.default_rng(2)
    margin = rng.normal(size=400)
    label = (rng.random(400) < 1 / (1 + np.exp(-2 * margin + 0.7))).astype(int)
    a, b = quality._curve(margin, label)
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum() + 0.5e-3 * a * a

    h = 1e-5
    assert abs(loss(a + h, b) - loss(a - h, b)) / (2 * h) < 1e-3 and abs(loss(a, b + h) - loss(a, b - h)) / (2 * h) < 1e-3
    assert all(loss(a, b) < loss(a + x, b + y) for x, y in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)))


def test_all_labelled_texts_are_learnt_from(spark):
    """Toxic texts here are long ones, which a bounded sample once left out."""
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words[(i * 7 + k) % 40] for k in range(18_000 if i % 10 == 0 else 30)) + (" zrgl zrgla" if i % 10 == 0 else ""), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int")
    asked = spark.createDataFrame([(1000, "w1 w2 zrgl w3 zrgla w4", "en"), (1001, "w1 w2 w3 w4", "en")], docs.schema)
    one, none = (r.score for r in toxicity.with_scores(asked, toxicity.train(docs, labels), "score", "limit").orderBy("doc_id").collect())
    assert len(rows[0][1]) > 60_000 and one > 0.5 > none


def test_shards_of_labelled_texts(spark, monkeypatch):
    """Several shards find the class, and give the same model however tables are split."""
    rng = random.Random(31)
    rows = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 40))) + (" zrgl" + rng.choice(["", "a", "ed"]) if i % 4 == 0 else ""), "en") for i in range(1200)]
    docs = spark.createDataFrame(rows + rows[:3] + [(5, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 128)
    a = toxicity.train(docs.repartition(1), labels)
    monkeypatch.setattr(toxicity, "SLICE_IDS", 400)
    b = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(a.table, b.table) and np.array_equal(a.out, b.out) and a.thresholds == b.thresholds and "en" in a.thresholds
    assert a.table.any() and not hasattr(a, "kept")
    got = a.score(pa.array([t for _, t, _ in rows]))
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in enumerate(got)]) > 0.98
