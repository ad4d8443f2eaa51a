"""SimHash near-duplicate groups by pigeonring filtering.

A text's fingerprint is the majority, bit by bit, of the XXH64 hashes of its
word shingles.  The 64 bits lie on a ring of `SEGMENTS` segments.  If two
fingerprints differ in at most r bits, then from some segment on, every chain
of l consecutive segments differs in at most l*r/SEGMENTS bits in all: with
five segments and r = 4 the first segment is equal and the second differs in
at most one bit.  So every fingerprint is filed under each (segment, next
segment) pair as it is, and also under the pairs whose second part has one bit
changed.  Two linked fingerprints always meet in a file of about 26 bits, and
in one of these files every longer chain keeps its budget too: candidates go as
soon as two, three or four segments from the file's first differ in more than
1, 2 or 3 bits, before whole fingerprints are compared.
Work and shuffle grow with the number of different fingerprints.  In a short
file all pairs are candidates; in a longer one a search over what is not yet
reached keeps a spanning forest, and in a very long one it looks only at
fingerprints whose third segment is within the chain's budget.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import give_back, short_batches, shuffle_partitions, stored, unused
from feedloom.llm.components import components
from feedloom.llm.text import LOWER_BYTES

SEGMENTS = 5
SEED = 42
#: In files of more fingerprints a search keeps a spanning forest; in shorter ones all pairs are compared.
SHORT_FILE = 24
#: In files of more fingerprints the search looks up third segments.
LONG_FILE = 8192


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of one UTF-8 text as an unsigned 64-bit number; 0 without words."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 32768):
        hi = min(n, lo + 32768)
        tails = ends[lo + shingle - 1 : hi + shingle - 1] if n > 1 or len(words) >= shingle else ends[-1:]
        hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), tails.tolist())])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long. A null text has no words."""
    short_batches(docs.sparkSession)

    def run(batches):
        give_back()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def filed(nodes: DataFrame) -> DataFrame:
    """(key, fp) for every file that a fingerprint is in."""

    def run(batches):
        give_back()
        parts = _bounds()
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            keys = []
            for i, (low, width) in enumerate(parts):
                low2, width2 = parts[(i + 1) % SEGMENTS]
                first = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                second = (fp >> np.uint64(low2)) & np.uint64((1 << width2) - 1)
                head = np.uint64(i << 40) | (first << np.uint64(20))
                keys += [head | (second ^ np.uint64(flip)) for flip in [0, *(1 << b for b in range(width2))]]
            out = [np.concatenate(keys).view(np.int64), np.tile(fp.view(np.int64), len(keys))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def chains(radius: int) -> tuple[np.ndarray, list[int]]:
    """Masks of the first 1 to SEGMENTS segments from each start (start, length), and the budget of each length."""
    one = [((1 << width) - 1) << low for low, width in _bounds()]
    masks = [np.bitwise_or.accumulate(np.array([one[(i + k) % SEGMENTS] for k in range(SEGMENTS)], np.uint64)) for i in range(SEGMENTS)]
    return np.stack(masks), [length * radius // SEGMENTS for length in range(1, SEGMENTS + 1)]


def viable(xor: np.ndarray, start: np.ndarray, radius: int) -> np.ndarray:
    """Places of the pairs, given as differing bits, of which every chain from `start`
    on keeps its budget; the longest chain is the whole fingerprint."""
    masks, budgets = chains(radius)
    at = np.arange(len(xor))
    for length in range(1, SEGMENTS):
        at = at[np.bitwise_count(xor[at] & masks[start[at], length]) <= budgets[length]]
    return at


def _flips(bits: int, width: int) -> list[int]:
    """The numbers of `width` bits of which at most `bits` are set."""
    flips = {0}
    for _ in range(bits):
        flips |= {f ^ (1 << b) for f in flips for b in range(width)}
    return sorted(flips)


def forest(fps: np.ndarray, start: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among the fingerprints of one file that
    keep the budgets of all chains from `start` on.

    What is not yet reached stands by its third segment in very long files, where one
    segment can't differ in more bits than the chain of three may.
    """
    low, width = _bounds()[(start + 2) % SEGMENTS]
    if len(fps) > LONG_FILE:
        third = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(third, kind="stable")
        values, firsts = np.unique(third[order], return_index=True)
        left = dict(zip(values.tolist(), np.split(fps[order], firsts[1:])))
    else:
        left = {0: fps}
    flips = _flips(3 * radius // SEGMENTS, width)

    def asked(x):
        if len(fps) <= LONG_FILE:
            return [0] if 0 in left else []
        value = (int(x) >> low) & ((1 << width) - 1)
        return [value ^ f for f in flips if value ^ f in left]

    def drop(place, keep):
        if len(keep):
            left[place] = keep
        else:
            del left[place]

    out = []
    for place in list(left):
        while place in left:
            queue = [left[place][0]]
            drop(place, left[place][1:])
            while queue and left:
                x = queue.pop()
                for near_place in asked(x):
                    rows = left[near_place]
                    near = viable(rows ^ x, np.full(len(rows), start), radius)
                    if len(near):
                        reached = rows[near]
                        drop(near_place, np.delete(rows, near))
                        out.append((np.full(len(reached), x), reached))
                        queue.extend(reached)
    return out


def links_in_files(key: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Links between the fingerprints of whole files, as pairs; `key` is sorted."""
    cut = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
    sizes = ends - starts
    first = key >> 40
    src, dst = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k in range(1, int(min(SHORT_FILE, sizes.max(initial=0)))):  # short files: rows k apart
        which = (sizes > k) & (sizes <= SHORT_FILE)
        many = sizes[which] - k
        at = np.repeat(starts[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        near = at[viable(fp[at] ^ fp[at + k], first[at], radius)]
        src.append(fp[near])
        dst.append(fp[near + k])
    for g in np.flatnonzero(sizes > SHORT_FILE):
        for a, b in forest(fp[starts[g] : ends[g]], int(first[starts[g]]), radius):
            src.append(a)
            dst.append(b)
    a, b = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
    pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) of fingerprints that connect the same groups as all pairs within `radius` bits do."""
    if radius >= SEGMENTS:
        raise ValueError("the files above are complete for radii under the number of segments")
    rows = filed(nodes).repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key")

    def run(batches):
        give_back()
        parts, held = [], 0  # whole files, then the last one so far
        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(2)]
            if len(now[0]) == 0:
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))
            if held + cut < 16384 or (cut == 0 and parts[-1][0][-1] == now[0][0]):
                parts.append(now)
                held += len(now[0])
                continue
            parts.append([x[:cut] for x in now])
            yield made(parts)
            parts, held = [[x[cut:] for x in now]], len(now[0]) - cut
        if parts:
            yield made(parts)

    def made(parts):
        key, fp = (np.concatenate(x) for x in zip(*parts))
        pairs = links_in_files(key, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`.

    component_id is the smallest id that links reach.  Null and empty texts have
    fingerprint zero and are linked like any other; a very long text has one
    fingerprint of all its shingles; rows that repeat an id stay rows; a null id
    gets a row with the smallest id of its group, or null if none has an id; an
    empty table gives no rows.  Other columns of `docs` are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle))
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(links(nodes, radius))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, without those that are near copies of one with a smaller id.
    Rows without id stay, and rows that repeat an id stay or go together."""
    found = near_duplicates(docs, id_col, text_col, **how)
    name = unused("__copy", docs.columns)
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(copies, F.col(f"`{id_col}`") == F.col(name), "left_anti")
