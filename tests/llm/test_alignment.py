"""Token links against whole encodings and byte offsets, pair by pair."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.tokenizers(*FILES))


def plain(pair, rows):
    """Groups by end offsets, links by pairs of tokens."""
    made, count = [], Counter()
    for i, t in rows:
        a = b = []
        if t:
            a = pair.a.encode(" " + t, add_special_tokens=False).ids
            b = pair.b.encode(t)
            want = (" " + t).encode()
            if b"".join(pair.bytes_a[k] for k in a) != want or b"".join(pair.bytes_b[k] for k in b) != want:
                a = b = []
        at_a, at_b = np.cumsum([len(pair.bytes_a[k]) for k in a]).tolist(), np.cumsum([len(pair.bytes_b[k]) for k in b]).tolist()
        both = sorted(set(at_a) & set(at_b))
        groups = [([], []) for _ in both]
        for ids, ends, side in ((a, at_a, 0), (b, at_b, 1)):
            g = 0
            for k, end in zip(ids, ends):
                groups[g][side].append(k)
                g += end == both[g]
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        made.append((i, a, b, groups, links))
        count.update(links.keys())
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for i, a, b, groups, links in made:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr), count


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = alignment.align(docs, *FILES)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


def texts(rng, n):
    parts = ["the", " ", "  ", "\n", "\t", "\n\n  ", " don't", " naïve", "日本語 の", " 12345", " ", " x", "  y", "\u0085", "=====", "a" * 37, " <s>", "<|endoftext|>", "\U0001f600", " ", " it's", "'s", " 'tis", "\r\n", "é́", "　", " foo_bar", "\x1f", " \x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_offsets(spark, pair, seed):
    rng = random.Random(seed)
    rows = list(enumerate(texts(rng, 150)))
    rows += rows[:4] + [(None, rows[7][1]), (None, None), (200, None), (201, ""), (202, " "), (203, "   "), (204, "a ▁ b and more"), (205, "▁")]
    want, _ = plain(pair, rows)
    assert run(spark, rows) == want
    assert sum(r[7] == "" for r in want) >= 5


def test_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, count = plain(pair, [tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, alignment.align(docs, *FILES).collect()), key=repr) == want
    got = {(r.id_a, r.id_b): r.n_docs for r in alignment.pair_counts(docs, *FILES).collect()}
    assert got == dict(count)


def test_out_of_step_and_long(spark, pair):
    # A run in which the tokenizers never end together, and a text of several panels.
    rows = [(1, "x" * 3001 + "é" * 501), (2, "word and other " * 40000), (3, "ab" * 100000), (4, " " * 5000 + "x")]
    assert run(spark, rows) == plain(pair, rows)[0]


def test_products():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (40, 30)) * (rng.random((40, 30)) < 0.2), rng.integers(0, 3, (30, 50)) * (rng.random((30, 50)) < 0.2)

    def csr(m):
        r, c = np.nonzero(m)
        return alignment.Csr.of(r, c, m[r, c], len(m))

    old, alignment.PANEL = alignment.PANEL, 16
    try:
        z = alignment.product(csr(x), csr(y))
    finally:
        alignment.PANEL = old
    out = np.zeros((40, 50), int)
    out[z.rows(), z.columns] = z.values
    assert (out == x @ y).all()


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("portion", F.lit("x")).withColumn("n_a", F.lit("y"))
    assert alignment.align(docs, *FILES).first().n_a == 2
