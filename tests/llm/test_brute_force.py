"""Operators that SQL can't express against plain versions, value by value."""
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import labelled, quality, sharding, simhash_dedup, substring_dedup, text, toxicity

VOCAB = [a + b for a in "ka lo mi nu re sa to vy".split() for b in "ba de fi go hu je".split()]
M = (1 << 64) - 1


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def spans_of(data):
    """Start and end of each word in bytes."""
    out, at = [], None
    for k, b in enumerate(data + b" "):
        if b in b" \t\n\x0b\x0c\r":
            if at is not None:
                out.append((at, k))
            at = None
        elif at is None:
            at = k
    return out


# -- 1 substring dedup ------------------------------------------------------------


def plain_chunks(t):
    """(first word, end word, digest) of each chunk."""
    data = (t or "").encode()
    words = spans_of(data)
    hashes = [mixed(sum((b + 1) * pow(text.BASE, k, 1 << 64) for k, b in enumerate(data[a:z])) & M) for a, z in words]
    value = [mixed(sum(hashes[i - k] << 16 * k for k in range(4) if i >= k) & M) for i in range(len(words))]
    out, start = [], 0
    for i in range(len(words)):
        before, after = value[max(0, i - 3) : i], value[i + 1 : i + 4]
        last = i == len(words) - 1
        low = all(value[i] < x for x in before) and all(value[i] <= x for x in after)
        if last or low or i + 1 - start == 64:
            out.append((start, i + 1, xxhash.xxh3_128_digest(data[words[start][0] : words[i][1]])))
            start = i + 1
    return out, words, data


def plain_dedup(rows, least=16):
    have = {}
    for i, t in rows:
        for _, _, d in plain_chunks(t)[0]:
            have.setdefault(d, set()).add(i)
    owner = {d: min(s) for d, s in have.items() if len(s) > 1}
    out = {}
    for i, t in rows:
        chunks, words, data = plain_chunks(t)
        pieces, last, spans, of, gone, lent, k = [], 0, [], set(), 0, 0, 0
        state = [("gone" if owner[d] != i else "lent") if d in owner else "" for _, _, d in chunks]
        while k < len(chunks):
            j = k
            while j + 1 < len(chunks) and state[j + 1] == state[k]:
                j += 1
            lo, hi = chunks[k][0], chunks[j][1]
            if hi - lo >= least and state[k] == "lent":
                lent += hi - lo
            if hi - lo >= least and state[k] == "gone":
                a, z = words[lo][0], words[hi][0] if hi < len(words) else len(data)
                pieces.append(data[last:a])
                last, gone = z, gone + hi - lo
                spans.append((len(data[:a].decode()), len(data[: words[hi - 1][1]].decode())))
                of |= {owner[d] for _, _, d in chunks[k : j + 1]}
            k = j + 1
        new = t if not spans else b"".join([*pieces, data[last:]]).decode()
        out[i] = (new, len(spans), gone, spans, sorted(of), lent)
    return out


def test_substring_dedup(spark, monkeypatch):
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (16, 17, 30, 64, 65, 130, 60, 60)] + ["é 漢字 " * 20, "x\t\ny " * 40]
    texts = [None, "", " \n "]
    for _ in range(120):
        parts = [prose(rng, rng.randint(0, 40)) for _ in range(3)] + rng.choices(shared, k=rng.randint(0, 2))
        rng.shuffle(parts)
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n", "  "]).join(parts) + rng.choice(["", " "]))
    texts += [texts[5], texts[5], " ".join(shared)]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    want = plain_dedup(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__doc": F.lit(1), "__of": F.lit(2), "__chunks": F.lit("x"), "key": F.lit(0), "lent_words": F.lit("old")})
    for hot in (substring_dedup.HOT, 300):  # with and without digests that are broadcast
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = {r.doc_id: (r.text, r.n_repeats, r.repeat_words, [tuple(x) for x in r.repeats], r.repeats_of, r.lent_words) for r in substring_dedup.dedup(frame).collect()}
        assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 20


def test_substring_rows_that_repeat_an_id(spark):
    rng = random.Random(22)
    passage = prose(rng, 80)
    rows = [(1, passage), (1, passage), (2, f"{prose(rng, 20)} {passage}"), (None, passage), (None, passage)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_repeats) for r in got) == [("1", 0), ("1", 0), ("2", 1), ("None", 0), ("None", 0)]


# -- 4 sharding -------------------------------------------------------------------


def draw(values, shard):
    """xxhash64 as Spark chains it over ("shard", number, id)."""
    seed = 42
    seed = xxhash.xxh64_intdigest(b"shard", seed)
    seed = xxhash.xxh64_intdigest(int(shard).to_bytes(4, "little", signed=True), seed)
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    return seed


@pytest.mark.parametrize("weights", [[1.0] * 16, [1.0, 2.0, 0.5]])
def test_draws_and_slots(spark, monkeypatch, weights):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    monkeypatch.setattr(sharding, "COPIES", 4)
    rng = random.Random(23)
    rows = [(rng.choice([None, rng.randint(-50, 5000)]) if k % 40 == 0 else k, rng.choice([None, "", prose(rng, 3)])) for k in range(1500)] + [(7, "same")] * 30
    got = sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string"), len(weights), weights).collect()
    assert len(got) == len(rows)

    def shard(i, weights):
        drawn = [-w / math.log(((draw([i], k) >> 11) + 0.5) / (1 << 53)) for k, w in enumerate(weights)]
        return max(range(len(weights)), key=lambda k: drawn[k])

    slots = {}
    for r in got:
        assert r.shard == shard(r.doc_id, weights) and r.grown_shard == shard(r.doc_id, [*weights, weights[0]])
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == texts


# -- 5 and 8 classifiers ----------------------------------------------------------


def test_sample_is_the_same_however_tables_are_split(spark):
    rng = random.Random(24)
    rows = [(k % 300, prose(rng, rng.randint(1, 60)), "en") for k in range(500)] + [(k, "long " * 4000, "fr") for k in range(290, 330)] + [(None, "x", "en"), (1, None, None)]
    marks = [(k, rng.choice([0, 1, None])) for k in range(330)] + [(k, 1) for k in range(0, 330, 7)] + [(None, 1), (400, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    a = labelled.sample(docs.repartition(1), labels.repartition(1), "toxic", 60, 10_000, extra=("lang",))
    b = labelled.sample(docs.repartition(7), labels.repartition(5), "toxic", 60, 10_000, extra=("lang",))
    best = {}
    for i, t, lang in rows:
        if i is not None and len(t or "") <= 10_000 and (i not in best or len(t or "") < len(best[i][0])):
            best[i] = (t or "", lang)
    label = {i: max(y for j, y in marks if j == i and y is not None) for i, y in marks if i is not None and any(j == i and x is not None for j, x in marks)}
    fit = {i for i in label if i in best and zlib.crc32(str(i).encode()) % 5}
    assert a == b and len({r[0] for r in a}) == len(a)
    for y in (0, 1):
        mine = {r[0] for r in a if r[2] == y}
        assert mine <= {i for i in fit if label[i] == y} and len(mine) == min(60, sum(label[i] == y for i in fit))
    assert all(len(r[1]) == len(best[r[0]][0]) for r in a)


def test_convolution_and_pooling():
    """The margin of each text by loops over its windows."""
    rng = random.Random(25)
    texts = [prose(rng, rng.randint(1, 40)).split(" ") for _ in range(80)]
    label = [k % 2 for k in range(80)]
    texts = [" ".join([*w, "zrgl"] if y else w) for w, y in zip(texts, label)]
    model = toxicity.Model(texts, label, ["en"] * 80)
    assert np.abs(model.out).max() > 0 and model.table.any()
    odd = [*texts[:20], "", "one", "two words", None]
    got = model.score(pa.array(odd))
    for t, score in zip(odd, got):
        ids = toxicity.Texts([t or ""]).ids
        vectors = [sum(model.table[i].astype(float) for i in row) for row in ids]
        margin = float(model.offset)
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS if vectors else 0):
                best = max(
                    sum(vectors[i + j] @ model.filters[k][j * toxicity.SIZE : (j + 1) * toxicity.SIZE, f].astype(float) for j in range(w) if i + j < len(vectors))
                    for i in range(len(vectors))
                )
                margin += max(best + float(model.shift[k * toxicity.FILTERS + f]), 0) * float(model.out[k * toxicity.FILTERS + f])
        assert abs(score - 1 / (1 + math.exp(-margin))) < 1e-4


def test_thresholds_by_language():
    rng = np.random.default_rng(26)
    model = toxicity.Model(["a"], [0], ["en"])
    label = np.tile([0, 1], 200)
    languages = np.array((["en"] * 200) + (["fr"] * 190) + (["de"] * 8) + [None, None], object)
    score = np.where(languages == "en", np.where(label == 1, 0.45, 0.25), np.where(label == 1, 0.75, 0.62)) + rng.normal(0, 0.01, 400)
    model._calibrate(score, label, np.ones(400, bool), languages)
    assert set(model.thresholds) == {"en", "fr"}
    for name, limit in model.thresholds.items():
        mine = languages == name
        wrong = [((score[mine & (label == 1)] < g).mean() + (score[mine & (label == 0)] >= g).mean()) for g in np.linspace(0.3, 0.7, 41)]
        at = np.argmin(np.abs(np.linspace(0.3, 0.7, 41) - limit))
        assert wrong[at] <= min(wrong) + 1e-9


def test_dual_descent():
    """The dual solution meets the conditions of an optimum, and equals plain descent's objective."""
    rng = np.random.default_rng(27)
    n, width = 60, 25
    x = (rng.random((n, width)) < 0.3) * rng.normal(0, 1, (n, width))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, n) > 0, 1.0, -1.0)
    cost = np.full(n, 0.5)
    rows, columns = np.nonzero(x)
    weights = quality.dual_descent(rows, columns, x[rows, columns], y, cost, width, rounds=2000)
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    alpha, plain = np.zeros(n), np.zeros(width)
    for _ in range(3000):
        for i in range(n):
            if x[i].any():
                new = min(max(alpha[i] - (y[i] * (plain @ x[i]) - 1) / (x[i] @ x[i]), 0), cost[i])
                plain = plain + (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    assert abs(primal(weights) - primal(plain)) < 1e-2 * primal(plain) and np.abs(weights - plain).max() < 0.05


def test_log_count_ratios():
    texts = ["good words here", "good words there", "bad words here", "bad bad there"] * 3
    row, column = quality._matrix(texts)
    label = np.array([1, 1, 0, 0] * 3)
    ratio = quality._scale(row, column, label, 1 << quality.BITS)
    for f in np.unique(column):
        has = {int(r) for r in row[column == f]}
        p, q = ((sum(label[r] == y for r in has) + 1) / (6 + 2) for y in (1, 0))
        assert abs(ratio[f] - (math.log(p / q) if len(has) >= quality.LEAST_DOCS else 0)) < 1e-12


# -- 7 simhash --------------------------------------------------------------------


def test_near_duplicates_with_clashing_columns(spark):
    rows = [(k, "a b c d e f g" if k % 2 else f"{k} b c d e f g") for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "fp", "node", "key", "component", "component_id", "fingerprint", "__copy")})
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(frame).collect()}
    assert got[1] == got[3] == got[5] == 1


def test_chains_from_some_start_keep_their_budgets():
    """Each pair within the radius passes from some segment on, each other pair from none; segment by segment."""
    rng = np.random.default_rng(3)
    for radius in range(5):
        xor = np.array([sum(1 << int(b) for b in rng.choice(64, k % 7, replace=False)) for k in range(1, 300)], np.uint64)
        passed = np.zeros(len(xor), bool)
        for start in range(simhash_dedup.SEGMENTS):
            at = simhash_dedup.viable(xor, np.full(len(xor), start), radius)
            passed[at] = True
            at = set(at.tolist())
            parts = [simhash_dedup._bounds()[(start + k) % 5] for k in range(5)]
            for i, x in enumerate(map(int, xor)):
                sums = np.cumsum([((x >> low) & ((1 << width) - 1)).bit_count() for low, width in parts])
                # A file stands for the first segment, which is equal there.
                assert (i in at) == all(sums[k] <= (k + 1) * radius // 5 for k in range(1, 5))
        assert (passed == (np.bitwise_count(xor) <= radius)).all()


def test_very_long_files_have_the_same_groups(monkeypatch):
    """Third segments looked up or not, a file's forest reaches what its links reach."""
    rng = np.random.default_rng(4)
    low, width = simhash_dedup._bounds()[1]
    bases = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    flips = np.array([0, *(1 << b for b in range(64) if not low <= b < low + width)], np.uint64)
    fps = np.unique(bases[rng.integers(0, 8, 150)] ^ flips[rng.integers(0, len(flips), 150)] ^ flips[rng.integers(0, len(flips), 150)])

    def groups(edges):
        of = {int(f): int(f) for f in fps}
        for a, b in edges:
            a, b = sorted((of[int(a)], of[int(b)]))
            of = {f: a if g == b else g for f, g in of.items()}
        return of

    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if len(simhash_dedup.viable(np.array([a ^ b]), np.array([1]), 4))]
    want = groups(links)
    for limit in (10**6, 10):
        monkeypatch.setattr(simhash_dedup, "LONG_FILE", limit)
        edges = [(x, y) for a, b in simhash_dedup.forest(fps, 1, 4) for x, y in zip(a, b)]
        assert groups(edges) == want and len(edges) == len(fps) - len(set(want.values()))
