"""Deleted interpolation against a plain model: counts, weights and scores."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ngram_lm

VOCAB = [a + b for a in "ka lo mi nu re sa to vy".split() for b in "ba de fi go hu je".split()]
SCHEMA = "doc_id long, text string"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def made(rng):
    texts = [None, "", "  \n\t ", "One", "é ü ñ 漢字 😀   x", "a" * 5000, "x " * 3000, "same text twice", "same text twice"]
    # words follow one another, so that bigrams tell something
    for _ in range(300):
        at, out = rng.randrange(len(VOCAB)), []
        for _ in range(rng.randint(0, 60)):
            at = (at * 5 + 7) % len(VOCAB) if rng.random() < 0.6 else rng.randrange(len(VOCAB))
            out.append(VOCAB[at])
        texts.append(" ".join(out))
    return texts


def bucket(c):
    return min(math.frexp(c)[1], ngram_lm.BUCKETS - 1)


class Plain:
    """The model over rows (id, text), token by token."""

    def __init__(self, rows, fold):
        self.one, self.two = collections.Counter(), collections.Counter()
        kept_one, kept_two, held = collections.Counter(), collections.Counter(), []
        for i, t in rows:
            if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
                w = [*words_of(t), None]
                for one, two in [(self.one, self.two)] + ([(kept_one, kept_two)] if t not in fold else []):
                    one.update(w)
                    two.update(zip([None, *w], w))
                held += zip([None, *w], w) if t in fold else []
        self.n, self.v = sum(self.one.values()), len(self.one)
        weights = [list(ngram_lm.START) for _ in range(ngram_lm.BUCKETS)]
        for _ in range(ngram_lm.ROUNDS):
            got = [[1e-3 * x for x in ngram_lm.START] for _ in weights]
            for h, x in held:
                b = bucket(kept_one[h])
                p = [weights[b][0] / (self.v + 1), weights[b][1] * kept_one[x] / max(1, sum(kept_one.values())), weights[b][2] * kept_two[h, x] / max(1, kept_one[h])]
                for k in range(3):
                    got[b][k] += p[k] / sum(p)
            new = [[x / sum(g) for x in g] for g in got]
            moved = max(abs(a - b) for x, y in zip(new, weights) for a, b in zip(x, y))
            weights = new
            if moved <= ngram_lm.CLOSE:
                break
        weights[0] = [weights[0][0] / sum(weights[0][:2]), weights[0][1] / sum(weights[0][:2]), 0.0]
        self.weights = weights

    def score(self, t):
        w, base, model = [*words_of(t), None], 0.0, 0.0
        for h, x in zip([None, *w], w):
            base += math.log10((self.one[x] + 1) / (self.n + self.v + 1))
            l = self.weights[bucket(self.one[h])]
            model += math.log10(l[2] * self.two[h, x] / max(1, self.one[h]) + l[1] * self.one[x] / self.n + l[0] / (self.v + 1))
        return len(w), sum(self.one[x] > 0 for x in w), self.n, base, model


def held_out_texts(spark, texts):
    """The texts that the operator's documented hash holds out for the weights."""
    rows = spark.createDataFrame([(t or "",) for t in texts], "text string").distinct()
    found = {r.text for r in rows.where(F.pmod(F.xxhash64("text", F.lit("weights")), F.lit(ngram_lm.FOLD)) == 0).collect()}
    return {t for t in texts if (t or "") in found}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = made(rng)
    return [(None if i in (20, 21) else 5 if i == 22 else i, t) for i, t in enumerate(texts)]


def test_scores_and_weights(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "PORTION", 4000)
    monkeypatch.setattr(ngram_lm, "RANGE_TOKENS", 500)
    kept, mixture = {}, ngram_lm.mixture
    monkeypatch.setattr(ngram_lm, "mixture", lambda *a: kept.setdefault("w", mixture(*a)))
    fold = held_out_texts(spark, [t for _, t in rows])
    plain = Plain(rows, fold)
    assert len(fold) > 10
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "code": F.lit("x"), "portion": F.lit(None).cast("string")})
    got = ngram_lm.score(docs).collect()
    assert np.allclose(kept["w"], plain.weights, atol=1e-9)
    want = collections.Counter((i, *plain.score(t)[:3], *(round(x, 6) for x in plain.score(t)[3:])) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_scores_do_not_depend_on_splits(spark, rows, monkeypatch, tmp_path):
    """Each step may see other splits and other numbers of tasks than the one before."""
    monkeypatch.setattr(ngram_lm, "PORTION", 4000)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs.write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    found = {}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    joined = ngram_lm.joined

    def changed(*a):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        return joined(*a)

    try:
        for size, parts, between in (("128m", 1, joined), ("3k", 6, joined), ("128m", 4, changed)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            monkeypatch.setattr(ngram_lm, "joined", between)
            found[size, parts] = sorted(((r.doc_id or -1, r.n_tokens, round(r.score, 8)) for r in ngram_lm.score(docs).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len({tuple(x) for x in found.values()}) == 1


def test_without_training_text(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, None)], SCHEMA)
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in ngram_lm.score(docs, F.lit(False)).collect())
    assert ngram_lm.score(docs.limit(0)).count() == 0
