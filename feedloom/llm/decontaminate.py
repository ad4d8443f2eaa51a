"""Benchmark decontamination by SimHash windows of an item's size.

A window can be as similar to an item as asked only if it has one of the item's
rarest shingles, those that make up more than the part that may differ.  A
document's word shingles are looked up among these, and for every item that is
met, the windows of its number of words around the met shingles are
fingerprinted (weighted SimHash from running sums of bits).  The fingerprints
of the met items are filed by blocks of bits: with 10 blocks and radius 19, two
fingerprints within the radius differ in at most one bit in some block, so a
block's file lists, as a set of bits for each value, the items within one bit;
a window looks its ten values up, and no fingerprint within the radius is
missed.  What passes the radius is decided by the exact similarity of weighted
shingles.  A shingle's weight is the number of bytes of its words.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Sent, drop_stored, short_batches, stored
from feedloom.llm.text import Powers, Words, blocks, mix, ngram_hashes

BLOCKS = 10
RADIUS = 19
EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
#: Bytes of benchmark text sent to the executors at once; a larger benchmark takes several passes.
SLICE_BYTES = 32 << 20


def _bits(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of 64 values +weight or -weight for each hash."""
    ones = np.unpackbits(mix(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.where(ones, weights[:, None], -weights[:, None])


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def shingles(words: Words, hashes: np.ndarray, lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the shingles of words lo to hi of a block."""
    n = max(1, min(n, hi - lo))
    at = np.arange(lo, hi - n + 1)
    size = np.concatenate(([0], np.cumsum(words.ends[lo:hi] - words.starts[lo:hi])))
    return ngram_hashes(hashes, at, n), (size[n:] - size[:-n]).astype(np.float64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    total = float((wa[ia] * ca).sum() + (wb[ib] * cb).sum())
    _, ka, kb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = float((wa[ia][ka] * np.minimum(ca[ka], cb[kb])).sum())
    return common / (total - common) if total > common else 1.0


class Benchmark:
    """Items (id, text, how often) of the benchmark with their shingles and fingerprints."""

    def __init__(self, items: list[tuple], n: int = 5, least: float = 0.8) -> None:
        self.n = n
        self.ids, self.sizes, self.items, self.many = [], [], [], []
        words, powers = None, Powers()
        texts = pa.array([x[1] or "" for x in items], pa.string())
        at = 0
        for lo, hi, buf, offs in blocks(texts):
            words = Words(buf, offs)
            hashes = words.hashes(powers)
            for k in range(hi - lo):
                a, b = int(words.at[k]), int(words.at[k + 1])
                if b > a:
                    h, w = shingles(words, hashes, a, b, n)
                    self.ids.append(items[at + k][0])
                    self.many.append(items[at + k][2])
                    self.sizes.append(b - a)
                    self.items.append((h, w))
            at += hi - lo
        # the rarest shingles of each item, by their number of words
        several = [np.unique(h, return_index=True, return_counts=True) for h, _ in self.items]
        many = dict(zip(*np.unique(np.concatenate([x[0] for x in several]), return_counts=True))) if several else {}
        rare = []
        for (h, at, count), (_, w) in zip(several, self.items):
            order = np.lexsort((h, np.array([many[x] for x in h])))
            sums = np.cumsum((w[at] * count)[order])
            rare.append(h[order[: int(np.searchsorted(sums, (1 - least) * sums[-1] + 1e-6)) + 1]])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(n, s) for s in self.sizes}):
            own = [k for k, s in enumerate(self.sizes) if min(n, s) == size]
            h = np.concatenate([rare[k] for k in own])
            who = np.repeat(own, [len(rare[k]) for k in own])
            order = np.argsort(h, kind="stable")
            h, who = h[order], who[order]
            keys, first = np.unique(h, return_index=True)
            flags = np.zeros(1 << 20, bool)
            flags[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables[size] = (flags, keys, np.append(first, len(h)), who)
        self.prints = np.array([_packed(_bits(h, w).sum(axis=0, keepdims=True))[0] for h, w in self.items], np.uint64) if self.items else np.zeros(0, np.uint64)

    def met(self, hashes: np.ndarray, at: np.ndarray, size: int):
        """(index into at, item) for shingles of `size` words that are among an item's rarest."""
        flags, keys, first, who = self.tables[size]
        maybe = np.flatnonzero(flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(keys, hashes[maybe])
        k[k == len(keys)] = 0
        good = keys[k] == hashes[maybe]
        maybe, k = maybe[good], k[good]
        many = first[k + 1] - first[k]
        place = np.repeat(maybe, many)
        item = who[np.repeat(first[k], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
        return place, item

    def candidates(self, items: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, index into items, bits that differ) for all pairs within the radius."""
        windows, whose, bits = [], [], []
        for lo in range(0, len(items), 64):  # a file's set has 64 items
            own = self.prints[items[lo : lo + 64]]
            found = np.zeros(len(prints), np.uint64)
            for low, high in zip(EDGES, EDGES[1:]):
                mask = np.uint64((1 << (high - low)) - 1)
                every = np.arange(1 << (high - low), dtype=np.uint64)
                near = np.bitwise_count(every[:, None] ^ ((own >> np.uint64(low)) & mask)) <= 1
                file = (near.astype(np.uint64) << np.arange(len(own), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                found |= file[((prints >> np.uint64(low)) & mask).astype(np.int64)]
            for k in range(len(own)):
                window = np.flatnonzero(found >> np.uint64(k) & np.uint64(1))
                far = np.bitwise_count(prints[window] ^ own[k])
                window, far = window[far <= RADIUS], far[far <= RADIUS]
                windows.append(window)
                whose.append(np.full(len(window), lo + k))
                bits.append(far)
        return np.concatenate(windows), np.concatenate(whose), np.concatenate(bits)


def _document(bench: Benchmark, words: Words, hashes: np.ndarray, lo: int, hi: int, hits: dict[int, list[int]], least: float):
    """Matches in words lo to hi of a block; hits: item to word indices of met shingles."""
    best: dict[int, tuple[float, int, int, int]] = {}
    by_size: dict[int, set[int]] = {}
    hits = {item: np.asarray(found) for item, found in hits.items()}
    for item in hits:
        by_size.setdefault(bench.sizes[item], set()).add(item)
    for size, items in by_size.items():
        n = min(bench.n, size)
        span = min(size, hi - lo)  # a shorter document is one window
        marks = np.zeros(hi - lo - span + 2, np.int64)
        for item in items:
            met = hits[item] - lo
            np.add.at(marks, np.maximum(0, met - span + n), 1)
            np.add.at(marks, np.minimum(hi - lo - span, met) + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        if len(starts) == 0 or span < n:
            continue
        groups = np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1)
        for group in (g[k : k + 4096] for g in groups for k in range(0, len(g), 4096)):
            a = lo + int(group[0])
            h, w = shingles(words, hashes, a, lo + int(group[-1]) + span, n)
            sums = np.concatenate((np.zeros((1, 64)), np.cumsum(_bits(h, w), axis=0)))
            at = lo + group - a
            wide = span - n + 1
            prints = _packed(sums[at + wide] - sums[at])
            around = sorted(k for k in items if np.any((hits[k] >= lo + group[0]) & (hits[k] <= lo + group[-1] + span - n)))
            window, item, far = bench.candidates(np.array(around), prints)
            for at_item in np.unique(item).tolist():
                k = around[at_item]
                own_h, own_w = bench.items[k]
                total = own_w.sum()
                inside = np.concatenate(([0.0], np.cumsum(np.where(np.isin(h, own_h), w, 0.0))))
                every = np.concatenate(([0.0], np.cumsum(w)))
                mine = np.flatnonzero(item == at_item)
                p = at[window[mine]]
                common = np.minimum(inside[p + wide] - inside[p], total)
                most = common / np.maximum(total + (every[p + wide] - every[p]) - common, 1e-9)  # at least the similarity
                for j in np.argsort(-most, kind="stable").tolist():
                    known = best.get(k)
                    if most[j] < least - 1e-9 or (known and known[0] > most[j] + 1e-9):
                        break
                    q = int(p[j])
                    exact = similarity(h[q : q + wide], w[q : q + wide], own_h, own_w)
                    start = a + q - lo
                    if exact >= least and (known is None or (exact, -start) > (known[0], -known[1])):
                        best[k] = (exact, start, span, int(far[mine[j]]))
    return best


def _sent(docs: DataFrame, benchmark: DataFrame, least: float, shingle: int, item_id: str, item_text: str, slice_bytes: int):
    """(broadcast, whether it is the last): the benchmark in slices of about
    `slice_bytes` of text, one after the other, so that the driver and the
    executors hold one at a time.  Equal rows are sent once, with their number."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text"))
    bench = bench.groupBy("item", "text").agg(F.count(F.lit(1)).alias("many"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    for k in range(slices):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k) if slices > 1 else bench
        sent = Sent(spark, Benchmark([tuple(r) for r in part.collect()], shingle, least))
        yield sent, k == slices - 1
        if k < slices - 1:
            sent.data.destroy()


def _found(bench: Benchmark, powers: Powers, column: pa.Array, least: float):
    """(row, item, similarity, start word, words, differing bits) of a column's matches."""
    for first, _, buf, offs in blocks(column):
        words = Words(buf, offs)
        if len(words.starts) == 0:
            continue
        hashes = words.hashes(powers)
        of_row = words.rows()
        by_doc: dict[int, dict[int, list[int]]] = {}
        for size in bench.tables:
            at = np.arange(max(0, len(hashes) - size + 1))
            at = at[of_row[at] == of_row[at + size - 1]] if size > 1 else at
            place, item = bench.met(ngram_hashes(hashes, at, size), at, size)
            for w, i in zip(at[place].tolist(), item.tolist()):
                by_doc.setdefault(int(of_row[w]), {}).setdefault(i, []).append(w)
        for k, hits in by_doc.items():
            lo, hi = int(words.at[k]), int(words.at[k + 1])
            for i, found in sorted(_document(bench, words, hashes, lo, hi, hits, least).items()):
                for _ in range(bench.many[i]):
                    yield (first + k, bench.ids[i], *found)


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, shingle: int = 5, doc_id: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, differing_bits): for each
    document and benchmark item of which it has a passage that is at least so
    similar, the most similar window (of equal ones, the first).

    Words are compared in lower case (A-Z).  Items of fewer words than a shingle
    are one shingle of all their words; items and documents without words (null,
    empty, white space) match nothing; very long texts are searched whole;
    repeated rows and ids match each on their own.  The benchmark is sent to
    executors in slices of a bounded size, one pass over the documents for each.
    Other columns are not read.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = ["doc_id", "item_id", "similarity", "start_word", "n_words", "differing_bits"]
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())

    def scan(sent):
        def run(batches):
            bench, powers = sent.value, Powers()
            for batch in batches:
                made = list(_found(bench, powers, batch.column(1), least))
                columns = list(zip(*made)) if made else [[]] * 6
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=names)

        return rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long, differing_bits int")

    out = None
    for sent, last in _sent(docs, benchmark, least, shingle, item_id, item_text, slice_bytes):
        part = scan(sent) if last else stored(scan(sent))
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, shingle: int = 5, text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents that match no benchmark item, with all their columns; nothing
    is shuffled.  A benchmark of several slices is a pass for each, stored between."""
    short_batches(docs.sparkSession)

    def kept(sent):
        def run(batches):
            bench, powers = sent.value, Powers()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for found in _found(bench, powers, batch.column(batch.schema.get_field_index(text_col)), least):
                    clean[found[0]] = False
                yield batch.filter(pa.array(clean))

        return run

    before = None
    for sent, last in _sent(docs, benchmark, least, shingle, item_id, item_text, slice_bytes):
        docs = docs.mapInArrow(kept(sent), docs.schema)
        if not last:
            docs = stored(docs)
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
