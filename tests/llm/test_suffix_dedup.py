"""Suffix-array dedup against all windows, and its transforms against sorted suffixes."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import suffix_dedup

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]


def plain(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        spans = list(zip(edge[::2], edge[1::2]))
        out.append((i, len(b), sum(z - a for a, z in spans), len(spans), spans, b"".join(b[k : k + 1] for k in range(len(b)) if not gone[k + 1])))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.dedup(docs, **options)
    assert found.columns == COLUMNS
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()), key=repr)


def corpus(rng, n, length):
    """Passages around the length in ever other surroundings, copies, edits and periods."""
    word = lambda k: "".join(rng.choice("abcdeé ") for _ in range(k))
    shared = [word(rng.randrange(length // 2, 3 * length)) for _ in range(6)] + ["xy" * length, "z" * (length + 3)]
    out = []
    for i in range(n):
        t = "".join(rng.choice([word(rng.randrange(length)), rng.choice(shared), rng.choice(shared)[rng.randrange(9) :]]) for _ in range(rng.randrange(5)))
        if t and rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + "Q" + t[k + rng.randrange(2) :]
        out.append((i, t))
    return out + [(None, out[3][1]), (n, None), (n + 1, ""), (n + 2, shared[0][: length - 1]), (n + 3, out[5][1])]


@pytest.mark.parametrize("seed, length, share", [(1, 20, 6), (2, 20, 20), (3, 9, 1), (4, 40, 11)])
def test_equals_all_windows(spark, monkeypatch, seed, length, share):
    monkeypatch.setattr(suffix_dedup, "PORTION", 4000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "SYMBOLS", 3000)
    rows = corpus(random.Random(seed), 120, length)
    want = plain(rows, length)
    assert sum(r[2] for r in want) > 1000
    assert run(spark, rows, length=length, share=share) == want


@pytest.mark.parametrize("hot", [2, 5])
def test_split_cores(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PORTION", 3000)
    rows = corpus(random.Random(7), 150, 30)
    assert run(spark, rows, length=30, share=20) == plain(rows, 30)


def test_production_length(spark):
    rng = random.Random(5)
    rows = corpus(rng, 60, 200)
    assert run(spark, rows) == plain(rows, 200)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows) == plain(rows, 200)


def test_merged_transforms():
    """Merging keeps each shard's order and finds all common prefixes up to the depth."""
    rng = random.Random(11)
    depth = 7
    shards = [[[rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))] for _ in range(5)] for _ in range(3)]
    transforms, suffixes = [], []
    for strings in shards:
        symbols = np.array([x for s in strings for x in [*s, 0]], np.uint16)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        order, before = suffix_dedup.transform(symbols, ends, depth)
        every = [tuple([*s, 0][k : k + depth]) for s in strings for k in range(len(s) + 1)]
        assert [every[k] for k in order] == sorted(every)
        transforms.append(before)
        suffixes.append([every[k] for k in order])
    origin, prefix = suffix_dedup.merge(transforms, depth)
    at = [iter(s) for s in suffixes]
    got = [next(at[k]) for k in origin.tolist()]
    assert got == sorted(x for s in suffixes for x in s)

    def common(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return depth if a == b else k

    assert prefix.tolist() == [0, *(common(a, b) for a, b in zip(got, got[1:]))]


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (3, "short")]) == [(1, 0, 0, 0, [], b""), (2, 0, 0, 0, [], b""), (3, 5, 0, 0, [], b"short")]
    same = "a passage " * 40
    assert run(spark, [(1, same)]) == plain([(1, same)], 200)
    rng = random.Random(2)
    long = "".join(rng.choice("abc ") for _ in range(300_000))
    got = run(spark, [(1, long + long[:1000]), (2, long[5000:5300])])
    assert [(r[2], r[3]) for r in got] == [(2300, 3), (300, 1)]
    clash = spark.createDataFrame([(1, same, "a", 1)], "doc_id long, text string, portion string, kept int").withColumn("n_bytes", F.lit("x"))
    assert suffix_dedup.dedup(clash).first().n_bytes == 400
    with pytest.raises(ValueError):
        suffix_dedup.dedup(clash, length=30, share=31)
