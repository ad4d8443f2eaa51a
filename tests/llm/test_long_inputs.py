"""Long urls and words: right, and in about linear time."""
import random
import time

from feedloom.llm import bpe, queries, url_filter


def test_long_hosts(spark):
    hosts = ["a." * 500_000 + "net", "b" * 1_000_000 + ".example.com", "x." * 300_000 + "example.net"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/de/8", "/en/" + "7" * 100_000, "")] * 2
    begin = time.time()
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()
    assert time.time() - begin < 30
    fits = lambda h, p: [(x + y, v) for v, x, y in queries.URL_RULES if (h == x or h.endswith("." + x)) and p.startswith(y)]
    for r in got:
        best = max(fits(r.host, r.path), key=lambda f: len(f[0]), default=(None, "allow"))
        assert (r.rule, r.verdict) == best


def test_probes_equal_all_suffixes():
    rng = random.Random(1)
    rules = [("block", ".".join(rng.choices("abc", k=rng.randint(1, 4))), rng.choice(["", "/", "/x", "/é/", "/xy/z"])) for _ in range(40)]
    sizes = url_filter.rule_sizes(rules)
    for _ in range(300):
        host, path = ".".join(rng.choices(["a", "b", "c", ""], k=rng.randint(1, 6))), rng.choice(["", "/", "/x", "/é/1", "/xy/z/q", "/xy"])
        probes = url_filter.probes_of(host, path, sizes)
        want = {h + p for _, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)}
        assert want == {x.decode() for x in probes} & {h + p for _, h, p in rules}
        assert [len(x.decode()) for x in probes] == sorted((len(x.decode()) for x in probes), reverse=True)


def library():
    import tiktoken

    path, pattern = queries.tokenizer()
    ranks = bpe.read_ranks(path)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Vocabulary(ranks), pattern


def test_long_words(monkeypatch):
    coder, vocabulary, pattern = library()
    rng = random.Random(2)
    words = ["Apr" * 350_000, "ab" * 500_000, "".join(rng.choices("etaoin", k=400_000)), "é漢" * 100_000]
    begin = time.time()
    encoder = bpe.Encoder(vocabulary, pattern)
    got = encoder.encode(words)
    assert time.time() - begin < 30
    for word, ids in zip(words, got):
        assert list(bpe.unpack(ids)) == coder.encode_ordinary(word)


def test_words_that_wait_are_merged_alone(monkeypatch):
    coder, vocabulary, _ = library()
    rng = random.Random(3)
    words = ["".join(rng.choices(letters, k=rng.randint(2, 150))).encode() for letters in ("ab", "aApPrR", "etaoinshrdlu", "é漢ab", "0189", "._-=") for _ in range(150)]
    want = [coder._core_bpe.encode_single_piece(w) for w in words]
    for patience in (0, 1, bpe.PATIENCE):
        monkeypatch.setattr(bpe, "PATIENCE", patience)
        assert [list(bpe.unpack(x)) for x in bpe.replay(words, vocabulary)] == want
    assert [list(bpe.unpack(bpe.replay_alone(w, vocabulary))) for w in words] == want
