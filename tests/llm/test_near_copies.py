"""Near copies of the pipeline against all pairs compared."""
import random

import corpus_pipeline
from pyspark.sql import functions as F

from feedloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [a + b for a in "ka lo mi nu re sa to vy".split() for b in "ba de fi go hu je".split()]


def prose(rng, n):
    return [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]


def edited(rng, words, n):
    """The words with n of them replaced."""
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = "edit" + rng.choice(VOCAB)
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


def wanted(words):
    """Ids of the smallest of each group, over all pairs."""
    root = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            if (not words[i] and not words[j]) or (words[i] and words[j] and jaccard(words[i], words[j]) >= 0.8):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [i for i, r in enumerate(root) if i == r]


def frame(spark, words):
    return spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(words)], SCHEMA)


def test_stage_drops_near_copies(spark):
    """Copies at a similarity of 0.8 to 0.95 go, those under 0.8 stay."""
    rng = random.Random(5)
    words = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    copies = [edited(rng, w, rng.randint(1, 6)) for w in words for _ in range(3)]
    words += copies + [[], [], ["one"], ["one"], ["two", "words"]]
    between = sum(0.8 <= jaccard(words[i // 3], c) < 0.95 for i, c in enumerate(copies))
    assert between >= 40 and any(jaccard(words[i // 3], c) < 0.8 for i, c in enumerate(copies))
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, words), "").collect())
    assert got == wanted(words)


def test_long_files(spark):
    """A line in all texts, and one group of many copies of which few are similar to the smallest id."""
    rng = random.Random(6)
    line, base = prose(rng, 12), prose(rng, 150)
    words = [prose(rng, rng.randint(20, 30)) + line for _ in range(80)]
    words += [edited(rng, base, rng.randint(2, 5)) for _ in range(120)]
    got = sorted(r.doc_id for r in near_copies.keep_one(frame(spark, words)).collect())
    assert got == wanted(words)


def test_rows_that_repeat_an_id(spark):
    """One row of each group stays, whatever ids its rows have; other texts of an id stay."""
    rng = random.Random(7)
    base, other = prose(rng, 60), prose(rng, 60)
    near = [*base[:-1], "edit"]
    texts = [(3, base), (3, near), (3, other), (3, other), (None, base), (1, other), (None, prose(rng, 9)), (None, prose(rng, 9)), (8, []), (9, [])]
    frame = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in texts], SCHEMA).withColumns({"__id": F.lit(1), "__hash": F.lit(2), "id": F.lit("x"), "hash": F.lit("y")})
    got = near_copies.keep_one(frame).collect()
    left = sorted((str(r.doc_id), r.text) for r in got)
    kept = [r.text for r in got if r.doc_id == 3]
    assert len(kept) == 1 and kept[0] in (" ".join(base), " ".join(near))
    assert left == sorted([("3", kept[0]), ("1", " ".join(other)), ("None", " ".join(texts[6][1])), ("None", " ".join(texts[7][1])), ("8", "")])
    twice = near_copies.keep_one(spark.createDataFrame([(5, "a b c d e f", "en", "s", 1)] * 3 + [(6, "a b c d e f", "en", "s", 1)], SCHEMA)).collect()
    assert [(r.doc_id, r.text) for r in twice] == [(5, "a b c d e f")]
    assert near_copies.keep_one(frame.limit(0)).count() == 0


def test_stage_takes_simhash_links(spark, monkeypatch):
    """Without the exact search, fingerprints alone show a near copy; a pair that is linked but under 0.8 stays."""
    from feedloom.llm import simhash_dedup

    rng = random.Random(9)

    def linked(n, edits, fits):
        while True:
            base = prose(rng, n)
            near = edited(rng, base, edits)
            apart = simhash_dedup.fingerprint(" ".join(base).encode()) ^ simhash_dedup.fingerprint(" ".join(near).encode())
            if fits(jaccard(base, near)) and apart.bit_count() <= 4:
                return [base, near]

    words = linked(120, 1, lambda j: 0.8 <= j < 1) + linked(40, 3, lambda j: j < 0.8) + [prose(rng, 40)]
    none = spark.createDataFrame([], "kind int, a long, b long, n int, rest int")
    monkeypatch.setattr(near_copies, "first_pairs", lambda nodes: none)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, words), "").collect())
    assert got == wanted(words) == [0, 2, 3, 4]
