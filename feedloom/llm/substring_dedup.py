"""Substring dedup by content-defined chunks.

Texts are cut between words where a gear rolling hash over the last words has
a minimum among its neighbours, so an insertion moves only the cuts near it.
Chunks are compared by a 128-bit digest of their bytes.  A digest that occurs
in several documents belongs to the one with the smallest id; a run of
consecutive chunks that belong to other documents is a repeated passage if it
has enough words, and is taken out.

Chunks never travel with their text.  Digests are aggregated to the smallest
and largest id and their number (pre-aggregated before the shuffle, so a very
common passage is a few rows), and only digests of several documents go back to
documents.  Digests that make up over one in `HOT` of all chunks are fewer than
`HOT`, whatever the input: they are broadcast, so no task meets all documents
with a common passage; the others are joined by digest.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import short_batches, stored, unused
from feedloom.llm.text import Powers, U64, Words, blocks, mix

WINDOW = 4  # words that the rolling hash sees
REACH = 3  # a cut is the minimum of so many neighbours on either side
LONGEST = 64  # words in a chunk
MIN_WORDS = 16  # words in a run of repeated chunks
HOT = 10_000  # a digest with more than this share of all chunks is broadcast


def chunk_ends(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Ascending indices after the last word of each chunk of a block's texts."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    row = words.rows()
    place = np.arange(n) - words.at[:-1][row]  # of a word in its text
    gear = np.zeros(n, U64)
    for k in range(WINDOW):
        gear[k:] += np.where(place[k:] >= k, hashes[: n - k] << U64(16 * k), U64(0))
    value = mix(gear)
    # Texts stand REACH places apart, with values above all hashes between them.
    at = np.arange(n) + REACH * (row + 1)
    wide = np.full(n + REACH * (len(words.counts) + 2), np.iinfo(np.uint64).max, U64)
    wide[at] = value
    cut = np.ones(n, bool)
    for k in range(1, REACH + 1):
        cut &= (value < wide[at - k]) & (value <= wide[at + k])
    cut[words.at[1:][words.counts > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], ends[:-1]))
    long = ends - starts > LONGEST
    if long.any():
        extra = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        ends = np.unique(np.concatenate([ends, *extra]))
    return ends


def chunk_digests(buf: np.ndarray, words: Words, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each chunk's digest."""
    starts = np.concatenate(([0], ends[:-1]))
    data, digest = buf.tobytes(), xxhash.xxh3_128_digest
    spans = zip(words.starts[starts].tolist(), words.ends[ends - 1].tolist())
    both = np.frombuffer(b"".join([digest(data[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _chunked(column: pa.Array):
    powers = Powers()
    for first, _, buf, offs in blocks(column):
        words = Words(buf, offs, lower=False)
        ends = chunk_ends(words, words.hashes(powers))
        if len(ends):
            high, low = chunk_digests(buf, words, ends)
        else:
            high = low = np.zeros(0, np.int64)
        yield first, buf, offs, words, ends, high, low


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(high, low, doc): the different digests of each row's chunks; rows without id have none."""
    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, _, _, words, ends, high, low in _chunked(batch.column(1)):
                row = first + words.rows()[ends - 1] if len(ends) else np.zeros(0, np.int64)
                order = np.lexsort((low, high, row))
                row, high, low = row[order], high[order], low[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(high[new]), pa.array(low[new]), pa.array(ids[row[new]])], names=["high", "low", "doc"])

    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(key.isNotNull()).select(key.cast("long").alias("doc"), text.alias("text"))
    return rows.mapInArrow(run, "high long, low long, doc long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` with repeated passages taken out of `text_col`, and with
    n_repeats (passages taken out), repeat_words (their words), repeats (their
    start and end in code points of the old text), repeats_of (ids of documents
    that keep a copy, ascending) and lent_words (words of passages that stay here
    and were taken out, or may have been, of other documents).

    Rows that share an id are one document and don't repeat each other.  Null
    texts stay null; rows without id and texts without words stay as they are; a
    very long text is chunked like any other; a run of exactly `min_words` words
    goes; an empty table gives no rows.  Columns named like a result are replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    parts = chunks(docs, id_col, text_col)
    many = parts.groupBy("high", "low").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    several = stored(many.where("first <> last").drop("last"))
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > total // HOT
    common = several.where(hot).select("high", "low", F.col("first").alias("common"))  # under HOT rows
    # A chunk that met a common digest has nothing else to meet: it goes anywhere.
    met = parts.join(F.broadcast(common), ["high", "low"], "left").withColumn("key", F.when(F.col("common").isNull(), F.col("low")).otherwise(F.xxhash64("doc", "high")))
    rest = several.where(~hot).select("high", F.col("low").alias("key"), "first")
    met = met.join(rest, ["high", "key"], "left").withColumn("first", F.coalesce("common", "first")).where("first is not null")
    added = "n_repeats long, repeat_words long, repeats array<struct<start:long,end:long>>, repeats_of array<long>, lent_words long"
    names = [part.split(" ")[0] for part in added.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    doc, of, own = (unused(c, docs.columns) for c in ("__doc", "__of", "__chunks"))
    found = met.groupBy(F.col("doc").alias(of)).agg(F.collect_set(F.struct("high", "first")).alias(own))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{id_col}`").cast("long").alias(doc))
    joined = rows.where(F.col(doc).isNotNull()).join(found, F.col(doc) == F.col(of), "left").drop(of)
    joined = joined.unionByName(rows.where(F.col(doc).isNull()).withColumn(own, F.lit(None).cast(found.schema[own].dataType)))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for field in spark.createDataFrame([], added).schema:
        schema = schema.add(field)

    def run(batches):
        for batch in batches:
            yield _without_repeats(batch, kept, text_col, names, min_words, doc, own)

    return joined.mapInArrow(run, schema)


def _runs(mark: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of marked chunks of one text."""
    before = np.concatenate(([False], mark[:-1] & (row[1:] == row[:-1]))) if len(mark) else mark
    after = np.concatenate((mark[1:] & (row[1:] == row[:-1]), [False])) if len(mark) else mark
    return np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after)


def _without_repeats(batch: pa.RecordBatch, kept: list[str], text_col: str, names: list[str], min_words: int, doc: str, own: str) -> pa.RecordBatch:
    text_at = batch.schema.get_field_index(text_col)
    column = batch.column(text_at)
    ids = batch.column(batch.schema.get_field_index(doc)).to_pylist()
    lists = batch.column(batch.schema.get_field_index(own))
    n = batch.num_rows
    texts = column.to_pylist()
    out = [[0] * n, [0] * n, [[] for _ in range(n)], [[] for _ in range(n)], [0] * n]
    busy = np.flatnonzero(np.asarray(lists.is_valid()))
    for first, buf, offs, words, ends, high, _ in _chunked(column.take(pa.array(busy)) if len(busy) else column.slice(0, 0)):
        if len(ends) == 0:
            continue
        starts = np.concatenate(([0], ends[:-1]))
        row = words.rows()[ends - 1]
        bounds = np.searchsorted(row, np.arange(len(offs)))
        for k in range(len(offs) - 1):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if a == b:
                continue
            r = int(busy[first + k])
            known = lists[r].values
            digest, owner = np.asarray(known.field("high")), np.asarray(known.field("first"))
            order = np.argsort(digest)
            digest, owner = digest[order], owner[order]
            at = np.searchsorted(digest, high[a:b])
            at[at == len(digest)] = 0
            hit = digest[at] == high[a:b]
            other = hit & (owner[at] != ids[r])
            one = row[a:b]
            base = int(offs[k])
            data = buf[base : int(offs[k + 1])]
            heads, tails = _runs(other, one)
            pieces, last, cuts = [], 0, []
            for i, j in zip(heads.tolist(), tails.tolist()):
                lo, hi = int(starts[a + i]), int(ends[a + j])
                if hi - lo < min_words:
                    continue
                s = int(words.starts[lo]) - base
                more = hi < len(words.starts) and words.starts[hi] < offs[k + 1]
                e = int(words.starts[hi]) - base if more else len(data)
                cuts.append((s, int(words.ends[hi - 1]) - base))
                out[1][r] += hi - lo
                out[3][r] = sorted({*out[3][r], *owner[at][i : j + 1].tolist()})
                pieces.append(data[last:s].tobytes())
                last = e
            if cuts:
                pieces.append(data[last:].tobytes())
                texts[r] = b"".join(pieces).decode("utf-8", "replace")
                flat = np.cumsum((data & 0xC0) != 0x80)
                out[0][r] = len(cuts)
                out[2][r] = [{"start": int(flat[s] - 1), "end": int(flat[e - 1])} for s, e in cuts]
            heads, tails = _runs(hit & ~other, one)
            spans = [int(ends[a + j] - starts[a + i]) for i, j in zip(heads.tolist(), tails.tolist())]
            out[4][r] = sum(x for x in spans if x >= min_words)
    columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in kept]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), spans, pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in zip(out, kinds))], names=[*kept, *names])
