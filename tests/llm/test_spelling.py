"""Spelling variants against all pairs of words."""
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from feedloom.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, many = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        many[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, many[w], counts.get(form[w])))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.variants(docs, **options)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, found.collect()))


def mixture(rng, n):
    letters = "abéÉÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            w = base[min(rng.randrange(15), rng.randrange(15))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice(letters), w[k] + rng.choice(letters)]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i % 40, rng.choice([" ", "-", "1\n"]).join(words)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = mixture(random.Random(seed), 120)
    rows += rows[:5] + [(None, rows[0][1]), (None, None), (7, None), (8, ""), (9, "12 \U0001f600 ab")]
    assert run(spark, rows) == plain(rows)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["lantern"] * 2000 + ["lanterm"] * 180 + ["lamterm"] * 12 + ["lamternn"] * 3 + ["lamtermm"] * 1)), (2, "lamtermm")]
    got = {w: (f, r) for w, f, r, *_ in run(spark, rows)}
    assert run(spark, rows) == plain(rows)
    assert got["lamterm"] == ("lanterm", "lantern") and got["lantern"] == (None, "lantern")


def test_ties_and_equal_letters(spark):
    # Words of equal frequency: the first by code points; `aab` and `ab` meet at both letters of a run and count once.
    rows = [(3, " ".join(["zebraaas"] * 30 + ["zebraas"] * 30 + ["zebraabs"] * 2))]
    assert run(spark, rows) == plain(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (3, "short words only")]) == []
    got = run(spark, [(5, "abcdefgh " * 40000)])
    assert [r[3] for r in got] == [40000]
    clash = spark.createDataFrame([(1, "lantern lantern", "a", 1)], "doc_id long, text string, word string, n int").withColumn("prefix", F.lit("x"))
    assert [r.word for r in spelling.variants(clash).collect()] == ["lantern"]


def test_long_words(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(n)) for n in (46, 47, 48, 49, 50, 120)] + ["a" * 48]
    words = [w for w in base for _ in range(2)]
    for w in base * 6:
        k = rng.randrange(len(w))
        words += [w[:k] + rng.choice(["", "b", w[k] + "a"]) + w[k + 1 :]] * rng.choice([1, 2, 3, 30])
    rows = [(i, w) for i, w in enumerate(words)]
    assert run(spark, rows) == plain(rows)
    big = "ab" * 100_000
    got = run(spark, [(1, f"{big} {big} {big[1:]} {big[1:]}")])
    assert sorted((len(r[0]), r[4]) for r in got) == [(199_999, 1), (200_000, 1)]
