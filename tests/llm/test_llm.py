"""The training-data operators on small fixtures, against brute force."""
import collections
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import (
    bpe, components, decontaminate, quality, queries, sharding, simhash_dedup, substring_dedup, text, toxicity, url_filter,
)

VOCAB = [a + b for a in "ka lo mi nu re sa to vy".split() for b in "ba de fi go hu je".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


def frame(spark, texts, ids=None, **more):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", "  \n\t ", "one", "Two words", "é ü ñ 漢字 😀 \u2028 x", "a" * 5000, "x " * 3000, "same text here again and again", "same text here again and again"]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, [5, 3, 9, 1, 7, 11, 2, 8, 4, 6])


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


# -- words ------------------------------------------------------------------------


def test_words_and_hashes():
    column = pa.array(["A b\tc", None, "", "x  yz ", "b c"])
    powers = text.Powers()
    for lo, hi, buf, offs in text.blocks(column):
        words = text.Words(buf, offs)
        got = [bytes(words.buf[a:b]).decode() for a, b in zip(words.starts, words.ends)]
        assert got == ["a", "b", "c", "x", "yz", "b", "c"] and words.counts.tolist() == [3, 0, 0, 2, 2]
        h = words.hashes(powers)
        assert h[1] == h[5] and h[2] == h[6] and len(set(h.tolist())) == 5
        two = text.ngram_starts(words, 2)
        assert two.tolist() == [0, 1, 3, 5]
        grams = text.ngram_hashes(h, two, 2)
        assert grams[1] == grams[3] and len(set(grams.tolist())) == 3


def test_hashes_do_not_depend_on_place(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)]
    whole = {}
    for piece in (1 << 19, 64):
        monkeypatch.setattr(text, "PIECE", piece)
        for limit in (1 << 20, 100):
            out = []
            for _, _, buf, offs in text.blocks(pa.array(texts), limit):
                out += text.Words(buf, offs).hashes(text.Powers()).tolist()
            whole[piece, limit] = out
    assert len({tuple(x) for x in whole.values()}) == 1


# -- 1 substring dedup ------------------------------------------------------------


def test_repeated_passages(spark):
    rng = random.Random(2)
    shared = prose(rng, 60)
    texts = [prose(rng, 150), f"{prose(rng, 40)} {shared} {prose(rng, 30)}", prose(rng, 200), f"{prose(rng, 11)} {shared} {prose(rng, 90)}", f"{shared}\n{prose(rng, 13)}", prose(rng, 30)]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, texts)).collect()}
    assert {i for i, r in got.items() if r.n_repeats} == {3, 4}
    assert got[3].repeats_of == [1] and got[1].lent_words >= 16 and not got[0].lent_words
    for i in (0, 1, 2, 5):
        assert got[i].text == texts[i]
    for i in (3, 4):
        for span in got[i].repeats:
            assert texts[i][span.start : span.end] in shared
        assert len(words_of(texts[i])) - len(words_of(got[i].text)) == got[i].repeat_words >= 30


def test_substring_odd_rows(spark, odd):
    got = {r.doc_id: r.text for r in substring_dedup.dedup(odd.withColumn("repeats", F.lit(1)).withColumn("high", F.lit(2)).withColumn("doc", F.lit(3))).collect()}
    assert got == dict(zip([5, 3, 9, 1, 7, 11, 2, 8, 4, 6], ODD))
    assert substring_dedup.dedup(odd.limit(0)).count() == 0
    assert substring_dedup.dedup(frame(spark, ["a b", "a b"], [None, None])).count() == 2


def test_cuts_resist_insertions():
    rng = random.Random(3)
    body = prose(rng, 400)

    def chunks(t):
        for _, _, buf, offs in text.blocks(pa.array([t])):
            words = text.Words(buf, offs, lower=False)
            ends = substring_dedup.chunk_ends(words, words.hashes(text.Powers()))
            return set(zip(*substring_dedup.chunk_digests(buf, words, ends)))

    a, b = chunks(body), chunks("new words in front " + body)
    assert len(a & b) >= len(a) - 2


# -- 2 urls -----------------------------------------------------------------------


def test_urls(spark):
    urls = ["https://Sub.Example.com/en/71", "http://example.com/en/8", "http://xexample.com/en/7", "https://a.net/de/8", "https://example.net/de/81?q", "http://org/es/#x", "http://b.org?es/", "nothing", None, "://", "x://com/en/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()}
    assert got[0] == ("sub.example.com", "/en/71", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2] == ("xexample.com", "/en/7", "com/en/", "block") and got[3][2:] == ("net/de/", "allow") and got[4] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[5] == ("org", "/es/", "org/es/", "block") and got[6] == ("b.org", "", None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10][2] == "com/en/"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, rule string"), queries.URL_RULES).count() == 0


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))  # everything collides
    (tmp_path / "a").write_bytes(url_filter.DigestArray.pack([("block", "aa", "/x"), ("allow", "bb", "/x"), ("block", "c", "/")]))
    array = url_filter.DigestArray(str(tmp_path / "a"))
    found = array.find([b"bb/x", b"aa/x", b"zz/x", b"c/", b"longer string"])
    assert [array.string(i) if i >= 0 else None for i in found] == ["bb/x", "aa/x", None, "c/", None]


# -- 3 bpe ------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd):
    import tiktoken

    path, pattern = queries.tokenizer()
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    letters = "aab\x00\x01 \n\t'sé漢😀.,0189²\u3000\x1c\x85\xa0THe"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(400)] + ["<|endoftext|>", "don't  stop \n x", "ab" * 800]
    rows = frame(spark, texts).withColumn("decoded", F.lit(0))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows, path, pattern), path).collect()}
    for i, t in enumerate(texts):
        assert list(bpe.unpack(bytes(got[i].token_ids))) == library.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode(rows.limit(0), path, pattern).count() == 0


def test_bpe_table_turns_over(monkeypatch):
    path, pattern = queries.tokenizer()
    vocabulary = bpe.Vocabulary(bpe.read_ranks(path))
    rng = random.Random(5)
    texts = [prose(rng, 50) for _ in range(30)]
    want = bpe.Encoder(vocabulary, pattern).encode(texts)
    monkeypatch.setattr(bpe, "TABLE_WORDS", 60)
    small = bpe.Encoder(vocabulary, pattern)
    assert [x for t in texts for x in small.encode([t])] == want


# -- 4 sharding -------------------------------------------------------------------


def test_sharding(spark, odd):
    rng = random.Random(6)
    rows = frame(spark, [prose(rng, rng.randint(0, 5)) for _ in range(3000)]).unionByName(odd).unionByName(frame(spark, [None, "x"], [None, None]))
    got = sharding.shard_table(rows.withColumn("slot", F.lit(1)).withColumn("shard", F.lit(1)), 16).collect()
    assert len(got) == 3012
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert 80 < sum(r.grown_shard == 16 for r in got) < 280
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 5 and r.size == 1} == {(1, 0)}
    assert sharding.shard_table(rows.limit(0)).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(4000).select(sharding.shard_of(["id"], [1.0, 3.0]).alias("s"))
    assert 0.70 < ids.agg(F.avg("s")).first()[0] < 0.80


# -- 5 and 8 classifiers ----------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    texts, marks = [], []
    for i in range(500):
        t = prose(rng, rng.randint(20, 80)).split(" ")
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(2):
                t.insert(rng.randint(0, len(t)), "zrgl" + rng.choice(["", "a", "ed", "ing", "s."]))
        if not good:
            t = [w for w in t for _ in range(3)]
        texts.append(" ".join(t))
        marks.append((i, int(good), int(toxic)))
    return frame(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_toxicity(spark, labelled, odd):
    docs, labels, marks = labelled
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(got[i].score, t) for i, _, t in marks if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in marks)
    assert auc(held) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    found = toxicity.score(odd.unionByName(frame(spark, [None], [None])), labels).collect()
    assert len(found) == 11 and len({r.score for r in found if r.doc_id in (5, 3, 9)}) == 1
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0


def test_quality(spark, labelled, odd):
    docs, labels, marks = labelled
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    held = [(got[i].score, q) for i, q, _ in marks if got[i].held_out]
    assert auc(held) > 0.97 and all(r.predicted == (r.score >= 0.3) for r in got.values())
    found = quality.score(odd.unionByName(frame(spark, [None], [None])), labels).collect()
    assert len(found) == 11 and len({r.score for r in found if r.doc_id in (5, 3, 9)}) == 1
    assert quality.score(docs.limit(0), labels.limit(0)).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, labelled):
    docs, labels, _ = labelled
    twisted = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs, twisted).collect()}
    assert all(abs(a[i] - b[i]) < 1e-12 for i in a)


# -- 7 simhash --------------------------------------------------------------------


def plain_print(t):
    w = words_of(t)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark):
    rng = random.Random(9)
    texts = list(ODD)
    for _ in range(25):
        base = prose(rng, 120).split(" ")
        for k in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            texts.append(" ".join(copy))
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert [got[i].component_id for i in range(len(texts))] == group
    kept = sorted(r.doc_id for r in simhash_dedup.keep_one(frame(spark, texts)).collect())
    assert kept == sorted(set(group))


def test_links_are_complete(spark):
    """Random fingerprints with planted neighbours, dense clusters of them included."""
    rng = random.Random(10)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 60])):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash_dedup.links(nodes)).collect()}
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    own = [found.get(p, p) for p in signed]
    assert [own.index(c) for c in own] == [group.index(g) for g in group]


def test_near_duplicates_odd_ids(spark):
    rows = frame(spark, ["a b c d e", "a b c d e", "q r s t u", "q r s t u", None], [None, 4, None, None, (1 << 62) + 7]).withColumn("fp", F.lit(1)).withColumn("node", F.lit(2))
    got = simhash_dedup.near_duplicates(rows).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(None, 4), (4, 4), (None, None), (None, None), ((1 << 62) + 7, (1 << 62) + 7)], key=str)
    assert simhash_dedup.keep_one(rows).count() == 5
    assert simhash_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


# -- 10 decontamination -----------------------------------------------------------


def bag(w):
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or collections.Counter([tuple(w)])


def weighted(a, b):
    size = lambda s: sum(len(x.encode()) for x in s)
    return sum(size(s) * min(c, b[s]) for s, c in a.items()) / sum(size(s) * max(a[s], b[s]) for s in set(a) | set(b))


@pytest.mark.parametrize("slice_bytes", [1 << 20, 800])
def test_decontamination(spark, slice_bytes):
    rng = random.Random(12)
    items = [prose(rng, rng.randint(6, 50)) for _ in range(20)] + ["Tiny item", None, "", items_twice := prose(rng, 12), items_twice]
    docs = list(ODD)
    for k in range(60):
        w = items[k % 20].split(" ")
        for _ in range(k // 20):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        docs.append(" ".join([prose(rng, rng.randint(0, 40)), *w, prose(rng, rng.randint(0, 40))]).strip())
    docs += [prose(rng, 100) for _ in range(20)] + ["x tiny ITEM y", items_twice.upper(), " ".join(items[3].split(" ")[:-1])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame(spark, docs), bench, slice_bytes=slice_bytes).collect()}
    want = {}
    for i, t in enumerate(docs):
        w = words_of(t)
        for j, item in enumerate(items):
            own = words_of(item)
            if not own or not w:
                continue
            span = min(len(own), len(w))
            if len(own) < 5 and len(w) < len(own):
                continue
            best = max(weighted(bag(w[p : p + span]), bag(own)) for p in range(len(w) - span + 1))
            if best >= 0.8:
                want[i, j] = best
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) >= 25
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame(spark, docs), bench, slice_bytes=slice_bytes).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


def test_decontamination_empty(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.matches(odd.limit(0), bench).count() == 0


# -- pipeline and queries ---------------------------------------------------------


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_pipeline(spark, tmp_path):
    """The stages' effects on planted documents, all at once."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    texts, marks = [], []
    for i in range(400):
        w = prose(rng, rng.randint(30, 80)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), "zrgl")
        texts.append(" ".join(w))
        marks.append((i, 1, int(toxic)))
    item, passage = prose(rng, 30), prose(rng, 70)
    texts += [texts[1], f"{prose(rng, 20)} {item} {prose(rng, 20)}", f"{prose(rng, 25)} {passage}", f"{passage} {prose(rng, 25)}", "", None]
    frame(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    clean = {i for i, _, t in marks if not t}
    assert clean <= set(got) and not {400, 401} & set(got) and len(set(got) & {i for i, _, t in marks if t}) <= 5
    assert {402, 403, 404} <= set(got) and 405 not in got  # of the two without words one stays
    assert got[403].n_chars < len(texts[403]) - 150 and got[402].n_chars == len(texts[402])
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in got.values())
    assert struct.unpack("<I", bytes(got[1].token_ids)[:4])[0] >= 0
