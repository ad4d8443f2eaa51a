"""Byte-level BPE by corpus-level merge replay.

The words (regex matches) of a block of texts are gathered once each.  An
inverted index maps every rank to the word positions where two neighbouring
tokens would join into the token of that rank.  Ranks are then applied in
order, lowest first, to the whole list of words; each merge touches the two
neighbours of the joined position only.  If a merge makes a pair of a rank
that is lower than the present one, the rest of that word waits until the
lower rank is done, so the result is that of merging each word by itself,
lowest rank first and leftmost first.  A word that waits very often is merged
alone, so long words take no square of their length.  Words are looked up again from a
bounded table while a task runs, so nothing is shuffled.
"""
from __future__ import annotations

import base64
import heapq
import struct
import sys
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import Sent, short_batches
from feedloom.llm.text import distinct

#: Parts of texts in a Python worker's table before the table becomes the old one;
#: parts met again move from the old table to the present one.
TABLE_WORDS = 150_000
#: A longer word is merged but not remembered.
TABLE_WORD_CHARS = 64
#: Characters of text whose new words are replayed together.
BLOCK_CHARS = 3_000_000
NONE = np.int32(2**31 - 1)
#: So often a word may wait for lower ranks before it is merged alone.
PATIENCE = 64
#: Marks a text's first part, which has no space before it; no UTF-8 text has it.
FIRST = "\ud800"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Vocabulary:
    """Ranks with what replaying them needs: the rank of each joinable pair of
    tokens, and which tokens can make a pair of a rank below their own."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        left, right = keys >> 32, keys & 0xFFFFFFFF
        self.falls = np.zeros(max(ranks.values()) + 1, bool)
        self.falls[left[values < left]] = True
        self.falls[right[values < right]] = True
        self.of_byte = np.array([ranks[bytes([k])] for k in range(256)], np.int32)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they don't join; -1 is no token."""
        want = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.values[at], NONE)


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Packed ids of each word; all the words are merged together in rank order."""
    text = np.frombuffer(b"\x00" + b"\x00".join(words) + b"\x00", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    gaps = np.concatenate(([0], np.cumsum(sizes + 1)))  # one place between words
    token = vocabulary.of_byte[text]
    token[gaps] = -1
    after = np.arange(1, len(text) + 1, dtype=np.int32)
    before = np.arange(-1, len(text) - 1, dtype=np.int32)
    rank_at = np.full(len(text), NONE, np.int32)  # of the pair that starts here
    for lo in range(0, len(text) - 1, 1 << 18):  # in pieces, which bounds the lookup's memory
        hi = min(len(text) - 1, lo + (1 << 18))
        rank_at[lo:hi] = vocabulary.pairs(token[lo:hi], token[lo + 1 : hi + 1])
    waits, alone = np.zeros(len(words), np.int32), []
    index: dict[int, list[np.ndarray]] = {}  # the inverted index: rank to places
    heap: list[int] = []

    def file(places: np.ndarray) -> None:
        found = rank_at[places]
        places, found = places[found != NONE], found[found != NONE]
        if len(places) == 0:
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        lo = 0
        for hi, rank in zip([*cuts.tolist(), len(found)], found[np.concatenate(([0], cuts))].tolist()):
            if rank in index:
                index[rank].append(places[lo:hi])
            else:
                index[rank] = [places[lo:hi]]
                heapq.heappush(heap, rank)
            lo = hi

    file(np.flatnonzero(rank_at != NONE).astype(np.int32))
    while heap:
        rank = heapq.heappop(heap)
        filed = index.pop(rank)
        at = filed[0] if len(filed) == 1 else np.concatenate(filed)
        at = at[rank_at[at] == rank]
        if len(at) > 1:
            at = distinct(at)
            # of places that overlap in a row, every other one
            row = np.concatenate(([False], after[at[:-1]] == at[1:]))
            if row.any():
                start = np.flatnonzero(~row)
                since = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[since % 2 == 0]
        fell = False
        if len(at) and vocabulary.falls[rank]:  # up to the first place of a word that makes a lower rank
            end = after[after[at]]
            joined = np.concatenate(([False], end[:-1] == at[1:]))
            left = np.where(joined, rank, token[before[at]])
            own = np.full(len(at), rank, np.int32)
            lower = (vocabulary.pairs(left, own) < rank) | (vocabulary.pairs(own, token[end]) < rank)
            if lower.any():
                word = np.searchsorted(gaps, at)
                head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                earlier = np.cumsum(lower) - lower
                keep = earlier == np.repeat(earlier[head], np.diff(np.append(head, len(at))))
                fell = not keep.all()
                cut = word[~keep]
                at = at[keep]
                if fell:  # words that wait too often are merged alone
                    cut = np.unique(cut) - 1
                    waits[cut] += 1
                    for w in cut[waits[cut] > PATIENCE].tolist():
                        alone.append(w)
                        rank_at[gaps[w] : gaps[w + 1]] = NONE
                    at = at[rank_at[at] == rank]
        if len(at) == 0:
            continue
        gone = after[at]
        end = after[gone]
        token[at], token[gone] = rank, -1
        rank_at[gone] = NONE
        after[at], before[end] = end, at
        left = before[at]
        rank_at[at] = vocabulary.pairs(token[at], token[end])
        joins = token[left] >= 0
        left = left[joins]
        rank_at[left] = vocabulary.pairs(token[left], token[at[joins]])
        file(np.concatenate((at, left)))
        if fell:
            more = np.concatenate(filed)
            more = more[rank_at[more] == rank]
            if len(more):
                if rank not in index:
                    heapq.heappush(heap, rank)
                index.setdefault(rank, []).append(more)
    kept = np.flatnonzero(token >= 0)
    packed = token[kept].astype("<u4").tobytes()
    bounds = (4 * np.searchsorted(kept, gaps)).tolist()
    out = [packed[lo:hi] for lo, hi in zip(bounds, bounds[1:])]
    for w in alone:
        out[w] = replay_alone(words[w], vocabulary)
    return out


def replay_alone(word: bytes, vocabulary: Vocabulary) -> bytes:
    """Packed ids of one word: its pairs in a heap by rank and place, which takes
    n log n steps however often a merge makes a lower rank."""
    ranks, n = vocabulary.ranks, len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts here
    rank_at = [ranks.get(word[k : k + 2]) for k in range(n)]
    rank_at[-1] = None
    heap = [r << 40 | k for k, r in enumerate(rank_at) if r is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        rank, at = top >> 40, top & (1 << 40) - 1
        if rank_at[at] != rank:
            continue
        gone = after[at]
        rank_at[gone] = None
        end = after[at] = after[gone]
        if end < n:
            before[end] = at
        left = before[at]
        for a, b in ((left, end), (at, after[end] if end < n else 0)):
            if 0 <= a < b:
                rank_at[a] = made = ranks.get(word[a:b])
                if made is not None:
                    heapq.heappush(heap, made << 40 | a)
            elif a >= 0:
                rank_at[a] = None
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return np.array(out, "<u4").tobytes()


class Encoder:
    """Encodes texts; keeps what it has met between spaces in a bounded table.

    A text is cut before each space that follows a non-space.  No match of a
    pattern that takes white space only at its start, or white space alone,
    crosses such a cut, so each part's matches are those of the whole text.
    Texts with other white space before a space are matched whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.table: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, each id as four little-endian bytes."""
        if len(self.table) > TABLE_WORDS:
            self.old, self.table = self.table, {}
        known, old = self.table, self.old
        split = [(FIRST + t).split(" ") for t in texts]
        fresh = set().union(*split).difference(known)
        met = fresh.intersection(old)
        known.update((part, old[part]) for part in met)
        fresh = list(fresh.difference(met))
        matches = [self.find(p[1:] if p[:1] == FIRST else " " + p) for p in fresh]
        ids = self._ids(set().union(*matches))
        for part, words in zip(fresh, matches):
            known[part] = None if not part or part[-1].isspace() else b"".join(map(ids.__getitem__, words))
        del matches, ids
        out: list[bytes | None] = []
        rest = []
        for k, parts in enumerate(split):
            try:
                out.append(b"".join(map(known.__getitem__, parts)))
            except TypeError:  # a part that can't stand alone
                out.append(None)
                rest.append(k)
        whole = [self.find(texts[k]) for k in rest]
        ids = self._ids(set().union(*whole))
        for k, words in zip(rest, whole):
            out[k] = b"".join(map(ids.__getitem__, words))
        for part in fresh:
            if len(part) > TABLE_WORD_CHARS or part[:1] == FIRST:
                del known[part]
        return out

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        ranks, coded = self.vocabulary.ranks, {w: w.encode() for w in words}
        merged = [w for w, c in coded.items() if c not in ranks]
        out = {w: ranks[c].to_bytes(4, "little") for w, c in coded.items() if c in ranks}
        out.update(zip(merged, replay([coded[w] for w in merged], self.vocabulary)))
        return out


def worker_encoder(sent, name: str, pattern: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    kept = sys.modules.setdefault("_feedloom_encoders", {})
    key = (name, pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(sent.value, pattern)
    return kept[key]


def gathered(batches, chars: int = BLOCK_CHARS):
    """Join Arrow batches until their text has about `chars` bytes: the words of
    more texts are replayed at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ranks(spark: SparkSession, path: str):
    """The rank file, read once on the driver and sent to the executors: its size
    is that of the vocabulary, whatever the input."""
    return Sent(spark, Vocabulary(read_ranks(path)))


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """`docs` with `out_col`: the ids of the whole text as little-endian unsigned
    32-bit numbers in a binary (see unpack()).

    A null or empty text has an empty binary.  Each row is encoded by itself, so
    ties and repeated rows change nothing; an empty table stays empty; other
    columns pass through, and a column named `out_col` is replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sent, key = _ranks(spark, rank_file), uuid.uuid4().hex
    rest = [c for c in docs.columns if c != out_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn(out_col, F.lit(b"")).schema

    def run(batches):
        encoder = worker_encoder(sent, key, pattern)
        for held in gathered(batches):
            column = [b.column(b.schema.get_field_index(text_col)).fill_null("").to_pylist() for b in held]
            coded = iter(encoder.encode([text for texts in column for text in texts]))
            for batch in held:
                ids = pa.array([next(coded) for _ in range(batch.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out_col])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def decode(docs: DataFrame, rank_file: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """`docs` with `out_col`: the bytes that the ids of `ids_col` stand for.

    Null ids give null; an id outside the vocabulary raises an error.  A column
    named `out_col` is replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sent = _ranks(spark, rank_file)
    rest = [c for c in docs.columns if c != out_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn(out_col, F.lit(b"")).schema

    def run(batches):
        tokens = {rank: token for token, rank in sent.value.ranks.items()}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = [None if x is None else b"".join(map(tokens.__getitem__, unpack(x))) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, out_col])

    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def unpack(ids: bytes) -> tuple[int, ...]:
    """Ids from the bytes that encode() gives."""
    return struct.unpack(f"<{len(ids) // 4}I", ids)
