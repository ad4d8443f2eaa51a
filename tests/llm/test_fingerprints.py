"""Fingerprints against sets of paragraph digests, and from their strings alone."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import fingerprints

SCHEMA = "doc_id long, text string"
VOCAB = [a + b for a in "ka lo mi nu re sa to vy".split() for b in "ba de fi go hu je".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


def edit(own, following):
    third = len(own) // 3
    return own[: len(own) - third] + following[:third]


def digests(t):
    return set(fingerprints.paragraphs([t])[0].tolist())


def like(x, y):
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


ODD = [None, "", "  \n\t ", "one", "Two words", "é ü ñ 漢字 😀   x", "a" * 5000, "x " * 3000, "same text here again and again", "same text here again and again"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ODD + [". ".join(prose(rng, 9) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += [prose(rng, 60_000), "line\n" * 3000, texts[-1] + " and more"]
    return list(zip(rng.sample(range(1000), len(texts)), texts))


def test_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"to": F.lit(1), "at": F.lit(1), "k": F.lit(1), "before": F.lit(0), "hash": F.lit(1)})
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    texts = {i: t or "" for i, t in rows}
    ids, prints = sorted(texts, reverse=True), {}
    assert set(got) == set(ids)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        own, following = texts[i], texts[after]
        new = edit(own, following)
        a, b, c = map(digests, (own, new, following))
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(got[i].near_edited - like(a, b)) < 1e-12 and abs(got[i].near_next - like(a, c)) < 1e-12
        # the strings alone say the same
        assert fingerprints.difference(got[i].fingerprint, got[i].edited_fingerprint) == (a - b, b - a, len(a & b))
        assert abs(fingerprints.near(got[i].fingerprint, got[i].edited_fingerprint) - got[i].near_edited) < 1e-12
        assert abs(fingerprints.near(got[i].fingerprint, got[after].fingerprint) - got[i].near_next) < 1e-12
        prints.setdefault(own, set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({p for x in prints.values() for p in x}) >= len(prints) - 1


def test_repeated_ids_are_cut_into_ranges(spark):
    """A third of the rows has one id and some have none; ties go by the text's hash."""
    rng = random.Random(12)
    made = [(7 if k % 3 == 0 else None if k % 10 == 1 else k, prose(rng, 8)) for k in range(400)]
    frame = spark.createDataFrame(made, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        got = fingerprints.fingerprints(frame).collect()
        ends, many = fingerprints._ends(frame.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")), 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert many[list(ends).index(7)] >= 4
    hashes = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(made, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]]), reverse=True)
    want = sorted((str(i), hashlib.sha256(edit(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == want


def test_few_rows(spark):
    docs = spark.createDataFrame([(4, "b b"), (4, "b b"), (None, "c"), (9, None)], SCHEMA)
    got = fingerprints.fingerprints(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "9", "None"]
    one = fingerprints.fingerprints(docs.where("doc_id = 9")).collect()
    assert [(r.n_chars, r.near_edited, r.near_next) for r in one] == [(0, 1.0, 1.0)]
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_stuck_sketches_grow(monkeypatch):
    """With far too few cells at first, all are made again until they can be peeled."""
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(1, 900)) for _ in range(20)]
    every, rows = fingerprints.paragraphs(texts), np.arange(20)
    want = fingerprints.likeness(every, rows, every, (rows + 1) % 20)
    monkeypatch.setattr(fingerprints, "cells_for", lambda n: np.full(len(n), 1, np.int64))
    prints, cells = fingerprints.sketched(every, 20)
    assert cells.max() > 16 and np.allclose(fingerprints.likeness(every, rows, every, (rows + 1) % 20), want)
    assert all(abs(fingerprints.near(prints[k], prints[(k + 1) % 20]) - want[k]) < 1e-12 for k in range(20))
    monkeypatch.setattr(fingerprints, "MOST", 0)
    monkeypatch.setattr(fingerprints.Sketches, "peel", lambda self: (*[np.zeros(0, np.int64)] * 3, np.zeros(len(self.cells), bool)))
    with pytest.raises(ValueError):
        fingerprints.sketched(every, 20)
