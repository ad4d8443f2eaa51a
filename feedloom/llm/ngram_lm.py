"""Language-model scores by deleted interpolation of bigrams and unigrams.

P(w | h) = l2(b) * c(h, w) / c(h) + l1(b) * c(w) / N + l0(b) / (V + 1)

where b is the bucket of c(h), the frequency of the context; the last part is
spread over the V training tokens and one unknown token.  The mixture weights
of every bucket are learned by expectation-maximisation on held-out counts: one
training text in `FOLD`, chosen by a hash of the text so that equal texts fall
together, is left out of the counts, and the weights are those that make the
texts left out most likely.  The model then takes all training texts.

Counting: the texts are read once and their tokens written as a table in which
a row is a portion, that is whole texts of about `PORTION` bytes.  Portions are
stored rows, so later steps see the same ones however the work is split or
repeated.  A portion sends one packed, sorted and compressed list of its
different n-gram hashes and counts to each range of hashes; a range adds up the
lists and sends to each portion the totals, in the portion's own order.  So
frequent n-grams cross the network once for a portion, the number of ranges
grows with the tokens (no task holds more than about `RANGE_TOKENS` of them),
and no table of n-grams is broadcast.
"""
from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import drop_stored, held_out, short_batches, shuffle_partitions, stored
from feedloom.llm.text import BASE, Powers, U64, Words, blocks, mix

#: Bytes of text in a portion.
PORTION = 12 << 20
#: Tokens of the input for each range of hashes; a range's lists take about nine bytes a token.
RANGE_TOKENS = 1 << 20
#: Of the training texts one in so many is held out to learn the mixture weights.
FOLD = 10
#: Hash that stands for the end of a text, as a token and as the first context.
END = U64(0x5851F42D4C957F2D)
#: Pairs are told apart by 56 bits, as their hashes are most of what is shuffled.
PAIR = ~U64(255)
#: Contexts seen less than 2, 4, 8 and so on times share a bucket.
BUCKETS = 24
#: Weights (unknown, unigram, bigram) before learning, and of buckets that no held-out token has.
START = (0.2, 0.4, 0.4)
ROUNDS, CLOSE = 40, 1e-3


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: sorted 64-bit numbers by their differences, others as they
    are, byte planes apart, compressed."""
    out = []
    for x in arrays:
        if x.dtype == np.uint64:
            x = np.diff(x, prepend=U64(0))
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""
        small = pa.Codec("zstd", compression_level=6).compress(planes, asbytes=True)
        out += [struct.pack("<QQc", len(small), len(x), x.dtype.char.encode()), small]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        small, n, kind = struct.unpack_from("<QQc", data, at)
        at += 17
        kind = np.dtype(kind.decode())
        planes = pa.decompress(data[at : at + small], n * kind.itemsize, codec="zstd", asbytes=True)
        x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        out.append(np.cumsum(x, dtype=np.uint64) if kind == np.uint64 else x)
        at += small
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits if they fit."""
    return x.astype(np.int32) if len(x) == 0 or x.max() < 1 << 31 else x.astype(np.int64)


def _batches(rows: list[tuple], names: list[str], kinds: tuple):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _table(spark_schema: str):
    """Names and Arrow types of a schema of these columns."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(part.split(" ") for part in spark_schema.split(", ")))
    return list(names), tuple(kinds[t] for t in types)


# -- portions ---------------------------------------------------------------------


PORTIONS = "portion string, tokens long, train long, kept long, ids binary, texts binary, words binary, places binary"


class Gathered:
    """Texts of a portion that is being filled."""

    def __init__(self) -> None:
        self.ids, self.codes, self.counts, self.hashes, self.size = [], [], [], [], 0

    def row(self, key: str) -> tuple:
        codes, counts, hashes = (np.concatenate(x) for x in (self.codes, self.counts, self.hashes))
        ends = np.cumsum(counts + 1) - 1
        tokens = np.empty(len(hashes) + len(counts), U64)
        tokens[ends] = END
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = hashes
        words, places, often = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.lexsort((words, -np.frexp(often)[1]))  # frequent words have small numbers, which pack well
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64())], names=["id"]))
        train, kept = (int((counts + 1)[which].sum()) for which in (codes > 0, codes == 1))
        return (key, len(tokens), train, kept, sink.getvalue().to_pybytes(), _pack(counts + 1, codes), _pack(words[order]), _pack(number[places.ravel()]))


def portions(docs: DataFrame, id_col: str, text_col: str, learn) -> DataFrame:
    """The stored table of portions.  A text's code is 0 outside training, 2 in
    the training texts held out for the weights, and 1 in the others."""
    weigh = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit("weights")), F.lit(FOLD)) == 0
    code = F.when(~learn, 0).when(weigh, 2).otherwise(1).cast("int")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), code.alias("code"))
    shape, most = _table(PORTIONS), PORTION

    def run(batches):
        powers, part, number = Powers(), Gathered(), 0
        for batch in batches:
            codes = np.asarray(batch.column(2)).astype(np.int8)
            for lo, hi, buf, offs in blocks(batch.column(1)):
                if part.size and part.size + len(buf) > most:
                    yield from _batches([part.row(f"{TaskContext.get().partitionId()} {number}")], *shape)
                    part, number = Gathered(), number + 1
                words = Words(buf, offs)
                part.ids += batch.column(0)[lo:hi].to_pylist()
                part.codes.append(codes[lo:hi])
                part.counts.append(words.counts)
                part.hashes.append(words.hashes(powers))
                part.size += len(buf) + hi - lo
        if part.ids:
            yield from _batches([part.row(f"{TaskContext.get().partitionId()} {number}")], *shape)

    # small row groups, as a row holds megabytes
    return stored(rows.mapInArrow(run, PORTIONS), block_bytes=16 << 20)


def _opened(texts: bytes, words: bytes, places: bytes):
    """Tokens of each text, codes, and for words and pairs: different hashes, and each token's place among them."""
    counts, codes = _unpack(texts)
    words, places = _unpack(words)[0], _unpack(places)[0]
    tokens, order = words[places], np.argsort(words)
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    words, places = words[order], number[places]
    pair = np.empty_like(tokens)  # the context, then in its place the pair's hash
    pair[1:] = tokens[:-1]
    pair[np.cumsum(counts) - counts] = END
    pair *= U64(BASE)
    pair += tokens
    del tokens
    pair += U64(1)
    pair = mix(pair)
    pair &= PAIR
    pairs, at = np.unique(pair, return_inverse=True)
    return counts, codes, ((words, places), (pairs, at.ravel()))


# -- counts -----------------------------------------------------------------------


LISTS = "part int, grams int, portion string, data binary"
TOTALS = "portion string, grams int, part int, data binary, v long"
JOINED = "ids binary, texts binary, tokens binary, ends long, cells binary, v long"


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted hashes of each of `parts` equal ranges begin; parts+1 indices."""
    edges = [U64((k << 64) // parts) for k in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, U64)), [len(keys)])).astype(np.int64)


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Two lists of sorted keys and counts as one."""
    keys, *counts = (np.concatenate(x) for x in zip(a, b))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(c[order], first) for c in counts)]


def lists(table: DataFrame, parts: int) -> DataFrame:
    """Each portion's lists of hashes, training counts and held-out counts, by range of hashes."""
    shape = _table(LISTS)

    def run(batches):
        for batch in batches:
            for key, texts, words, places in zip(*(c.to_pylist() for c in batch.columns)):
                counts, codes, grams = _opened(texts, words, places)
                code = np.repeat(codes, counts)
                for k, (keys, at) in enumerate(grams):
                    train, fold = (np.bincount(at, which, len(keys)).astype(np.int32) for which in (code > 0, code == 2))
                    cuts = _cuts(keys, parts).tolist()
                    rows = [(p, k, key, _pack(keys[a:b], train[a:b], fold[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                    for lo in range(0, len(rows), 256):
                        yield from _batches(rows[lo : lo + 256], *shape)

    return table.select("portion", "texts", "words", "places").mapInArrow(run, LISTS)


def totals(dealt: DataFrame) -> DataFrame:
    """Total training and held-out counts in the order of each portion's own list;
    `v` is how many of a range's words are in training."""
    shape = _table(TOTALS)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for part, grams, portion, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, grams) != now and held:
                    yield from added(*now, held)
                    held = []
                now = (part, grams)
                held.append((portion, data))
        if held:
            yield from added(*now, held)

    def added(part, grams, held):
        level: list = []  # sums of lists, merged two and two as they come
        for _, data in held:
            one, depth = _unpack(data), 0
            one = [one[0], *(c.astype(np.int64) for c in one[1:])]
            while level and level[-1][0] == depth:
                one, depth = _sum(level.pop()[1], one), depth + 1
            level.append((depth, one))
        whole = level.pop()[1]
        while level:
            whole = _sum(level.pop()[1], whole)
        keys, train, fold = whole
        rows = [(f"range {part}", -1, part, None, int((train > 0).sum()))] if grams == 0 else []
        for portion, data in held:
            at = np.searchsorted(keys, _unpack(data)[0])
            rows.append((portion, grams, part, _pack(_small(train[at]), _small(fold[at])), 0))
            if len(rows) > 64:
                yield from _batches(rows, *shape)
                rows = []
        yield from _batches(rows, *shape)

    return dealt.mapInArrow(run, TOTALS)


def joined(table: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """The stored table of tokens with their totals: a row is a portion with its
    ids, tokens of each text, c(w) and c(h, w) of each token and c(end); `cells`
    are the counts (c(h), c(h, w), c(w), how many) of its held-out tokens without
    the held-out texts.  Rows with `v` have the training words of a range."""
    shape = _table(JOINED)

    def own(batches):
        for batch in batches:
            for portion, ids, texts, words, places in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(portion, -5, 0, ids, 0), (portion, -4, 0, texts, 0), (portion, -3, 0, words, 0), (portion, -2, 0, places, 0)]
                yield from _batches(rows, *_table(TOTALS))

    def run(batches):
        now, held = None, {}
        for batch in batches:
            for portion, grams, part, data, v in zip(*(c.to_pylist() for c in batch.columns)):
                if grams == -1:
                    yield from _batches([(None, None, None, None, None, v)], *shape)
                    continue
                if portion != now and held:
                    yield from whole(held)
                    held = {}
                now = portion
                held[grams, part] = data
        if held:
            yield from whole(held)

    def whole(held):
        counts, codes, grams = _opened(held[-4, 0], held[-3, 0], held[-2, 0])
        starts = np.cumsum(counts) - counts
        seen = []
        for k, (keys, at) in enumerate(grams):
            lists = [_unpack(held[o, p]) for o, p in sorted(held) if o == k]
            train, fold = (np.concatenate(x) for x in zip(*lists))
            if len(train) != len(keys):
                raise ValueError("totals don't meet their portion")
            seen.append((train, fold, at))
        end = int(np.searchsorted(grams[0][0], END))
        (word, word_fold, at), (pair, pair_fold, at2) = seen
        out = np.flatnonzero(np.repeat(codes == 2, counts))
        kept_word, kept_pair = word.astype(np.int64) - word_fold, pair.astype(np.int64) - pair_fold
        before = np.concatenate(([end], at[:-1]))
        before[starts] = end
        cells, many = np.unique(np.stack((kept_word[before[out]], kept_pair[at2[out]], kept_word[at[out]])), axis=1, return_counts=True)
        row = (held[-5, 0], held[-4, 0], _pack(word[at], pair[at2]), int(word[end]), _pack(*map(_small, (*cells, many))), None)
        yield from _batches([row], *shape)

    sent = table.select("portion", "ids", "texts", "words", "places").mapInArrow(own, TOTALS)
    dealt = sent.unionByName(found).repartition(parts, "portion").sortWithinPartitions("portion", "grams", "part")
    return stored(dealt.mapInArrow(run, JOINED), block_bytes=16 << 20)


# -- weights ----------------------------------------------------------------------


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one more for each doubling of its frequency."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def held_out_cells(found: DataFrame) -> DataFrame:
    """(b, h, hw, w, many): how many held-out tokens have a context bucket and counts in the texts that are kept."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                h, hw, w, many = (x.astype(np.int64) for x in _unpack(data))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket(h).astype(np.int64), h, hw, w, many)], names=["b", "h", "hw", "w", "many"])

    cells = found.where("cells is not null").select("cells").mapInArrow(run, "b long, h long, hw long, w long, many long")
    return cells.groupBy("b", "h", "hw", "w").agg(F.sum("many").alias("many"))


def mixture(cells: DataFrame, kept: int, v: int, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights (unknown, unigram, bigram) of each bucket by expectation-maximisation
    over the held-out cells; a round is one aggregate of a few numbers a bucket.
    It ends when no weight moves by more than `close`."""
    weights = np.tile(np.array(START), (BUCKETS, 1))
    for _ in range(rounds):
        of = [F.element_at(F.array(*map(F.lit, weights[:, k].tolist())), F.col("b").cast("int") + 1) for k in range(3)]
        p = [of[0] / F.lit(float(v + 1)), of[1] * F.col("w") / F.lit(float(max(kept, 1))), of[2] * F.col("hw") / F.greatest("h", F.lit(1))]
        parts = cells.select("b", "many", *(x.alias(f"p{k}") for k, x in enumerate(p))).withColumn("all", F.col("p0") + F.col("p1") + F.col("p2"))
        sums = parts.groupBy("b").agg(*(F.sum(F.col("many") * F.col(f"p{k}") / F.col("all")).alias(f"s{k}") for k in range(3)))
        got = 1e-3 * np.tile(np.array(START), (BUCKETS, 1))
        for r in sums.collect():  # a row a bucket
            got[r.b] += (r.s0, r.s1, r.s2)
        new = got / got.sum(axis=1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved <= close:
            break
    weights[0, 2] = 0.0  # an unseen context has no bigrams
    weights[0] /= weights[0].sum()
    return weights


# -- scores -----------------------------------------------------------------------


def scored(found: DataFrame, n: int, v: int, weights: np.ndarray) -> DataFrame:
    """Base and model log10 probabilities of each text."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for batch in batches:
            for ids, texts, tokens, ends in zip(*(c.to_pylist() for c in batch.columns)):
                ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
                counts, codes = _unpack(texts)
                word, pair = (x.astype(np.int64) for x in _unpack(tokens))
                at = np.cumsum(counts) - counts
                context = np.concatenate(([0], word[:-1]))
                context[at] = ends
                base = np.log10(word + 1.0) - np.log10(float(n + v + 1))
                w = weights[bucket(context)]
                p = w[:, 2] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 0] / (v + 1)
                sums = [np.add.reduceat(x, at) for x in (base, np.log10(p), (word > 0).astype(np.int64))]
                columns = [ids, pa.array(codes == 0), pa.array(counts.astype(np.int64)), pa.array(sums[2]), pa.array(np.full(len(counts), n, np.int64)), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return found.where("ids is not null").select("ids", "texts", "tokens", "ends").mapInArrow(run, schema)


def score(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows where `learn` holds train the model (by default those whose crc32 of the
    id, modulo 7, is not 2); all are scored.  Null texts are empty and have the
    end token only; null ids, repeated ids and repeated rows are rows like any
    other; a very long text is a portion of its own; an empty table gives no
    rows; with no training text all probability is on the unknown token, and
    where no training text is held out or kept for the weights they stay near
    `START`.  Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    learn = ~held_out(id_col, 7, 2) if learn is None else F.coalesce(learn, F.lit(False))
    table = portions(docs, id_col, text_col, learn)
    tokens, n, kept, many = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "train", "kept")), F.count(F.lit(1))).first()
    parts = max(shuffle_partitions(spark), -(-tokens // RANGE_TOKENS))
    dealt = lists(table, parts).repartitionById(parts, "part").sortWithinPartitions("part", "grams", "portion")
    found = joined(table, totals(dealt), max(shuffle_partitions(spark), 2 * many))
    drop_stored(table)
    v = found.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    cells = stored(held_out_cells(found))
    weights = mixture(cells, kept, v) if n else np.tile([1.0, 0.0, 0.0], (BUCKETS, 1))
    drop_stored(cells)
    return scored(found, n, v, weights)
