"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (lines, cut at sentence ends and, inside long sentences,
after words chosen by their own hash) are hashed to 64-bit digests, which are
numbered when a paragraph repeats.  A sketch adds every digest to one cell in
each of three ranges; a cell has a count, the digests' xor and a check's xor.
A fingerprint is a sketch with about three cells for two digests, or more until
its own digests can be peeled off it.  The sketches of two texts subtract cell
by cell, what both have cancels, and cells with one digest are peeled until
nothing is left: what was peeled are the digests that differ.  If peeling gets
stuck, or the sketches differ in size, both are made again with more cells from
the digests that they hold, so two fingerprints are all that a comparison
needs.  Likeness is 2 * common / (all digests of both), from the numbers of
digests and of those that differ.  All work is vectorised over a batch of texts.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import short_batches, shuffle_partitions
from feedloom.llm.text import U64, Powers, Words, blocks, mix, slice_hashes

RANGES = 3
#: Cells in each range of a sketch: a power of two, this at least; a stuck one gets GROWTH times as many.
CELLS, GROWTH = 4, 2
#: A sketch that has so many cells and more than 64 for each digest is not made larger.
MOST = 1 << 20
#: One word in so many ends a paragraph by its hash.
WORDS_A_CUT = 16
STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the texts' paragraphs, text by text, and where each text's begin (one more than texts)."""
    powers, found, counts = Powers(), [], []
    for lo, hi, buf, offs in blocks(pa.array(texts, pa.large_string())):
        words = Words(buf, offs, lower=False)
        if len(words.starts) == 0:
            counts.append(np.zeros(hi - lo, np.int64))
            continue
        line = np.cumsum(buf == 10)
        cut = STOPS[buf[words.ends - 1]] | (words.hashes(powers) % U64(WORDS_A_CUT) == 0)
        cut[:-1] |= line[words.starts[1:]] > line[words.ends[:-1] - 1]
        cut[words.at[1:][words.counts > 0] - 1] = True
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate(([0], ends[:-1]))
        row = words.rows()[ends - 1]
        digests = slice_hashes(buf, words.starts[starts], words.ends[ends - 1], powers)
        order = np.lexsort((digests, row))
        digests, row = digests[order], row[order]
        # the second and later copies of a paragraph get digests of their own
        head = np.flatnonzero(np.concatenate(([True], (digests[1:] != digests[:-1]) | (row[1:] != row[:-1]))))
        copy = np.arange(len(digests)) - np.repeat(head, np.diff(np.append(head, len(digests))))
        found.append(np.where(copy > 0, mix(digests + copy.astype(U64)), digests))
        counts.append(np.bincount(row, minlength=hi - lo))
    every = np.concatenate(found) if found else np.zeros(0, U64)
    return every, np.concatenate(([0], *[np.cumsum(c) for c in [np.concatenate(counts) if counts else np.zeros(0, np.int64)]])).astype(np.int64)


def _check(digests: np.ndarray) -> np.ndarray:
    return (mix(digests + U64(0x1234567)) >> U64(32)).astype(np.uint32)


def cells_for(n: np.ndarray) -> np.ndarray:
    """Cells in each range for so many digests: the power of two from half their number."""
    least = np.maximum(CELLS, (np.asarray(n, np.int64) + 1) // 2)
    return np.int64(1) << np.ceil(np.log2(least)).astype(np.int64)


class Sketches:
    """The cells of many texts, or of the differences of many pairs of texts; each has cells of its own number."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = np.asarray(cells, np.int64)
        self.base = np.concatenate(([0], np.cumsum(RANGES * self.cells)))
        self.count = np.zeros(self.base[-1], np.int64)
        self.key = np.zeros(self.base[-1], np.uint64)
        self.check = np.zeros(self.base[-1], np.uint32)

    def places(self, who: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The cell of each digest in each range, one row a range."""
        cells, base = self.cells[who], self.base[who]
        return np.stack([(mix(digests ^ U64(0xA5A5 + k)) & (cells - 1).astype(U64)).astype(np.int64) + k * cells + base for k in range(RANGES)])

    def add(self, who: np.ndarray, digests: np.ndarray, sign) -> None:
        check = _check(digests)
        for at in self.places(who, digests):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digests)
            np.bitwise_xor.at(self.check, at, check)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, "right") - 1

    def copy(self) -> Sketches:
        out = Sketches.__new__(Sketches)
        out.cells, out.base = self.cells, self.base
        out.count, out.key, out.check = self.count.copy(), self.key.copy(), self.check.copy()
        return out

    def texts(self) -> list[str]:
        """Each sketch as its number of cells, a colon, and counts (8 bits), keys and checks, little-endian, in base64."""
        out = []
        for cells, a, b in zip(self.cells.tolist(), self.base.tolist(), self.base[1:].tolist()):
            raw = self.count[a:b].astype("i1").tobytes() + self.key[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u4").tobytes()
            out.append(f"{cells}:{base64.b64encode(raw).decode()}")
        return out

    @staticmethod
    def read(texts: list[str]) -> Sketches:
        """The sketches that texts() wrote."""
        parts = [t.split(":") for t in texts]
        out = Sketches(np.array([int(c) for c, _ in parts], np.int64))
        for (_, data), a, b in zip(parts, out.base.tolist(), out.base[1:].tolist()):
            raw, n = base64.b64decode(data), b - a
            out.count[a:b] = np.frombuffer(raw, "i1", n)
            out.key[a:b] = np.frombuffer(raw, "<u8", n, n)
            out.check[a:b] = np.frombuffer(raw, "<u4", n, 9 * n)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Peel what is in the sketches: (sketch, digest, sign) of what came off, and which sketches are empty now."""
        who, what, signs = [], [], []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            look = look[_check(self.key[look]) == self.check[look]]
            value, own = self.key[look], self.owner(look)
            fits = (self.places(own, value) == look).any(axis=0)
            look, value, own = look[fits], value[fits], own[fits]
            if len(look) == 0:
                break
            order = np.lexsort((value, own))
            first = order[np.concatenate(([True], (value[order][1:] != value[order][:-1]) | (own[order][1:] != own[order][:-1])))]
            value, own, sign = value[first], own[first], self.count[look[first]]
            self.add(own, value, -sign)
            who.append(own)
            what.append(value)
            signs.append(sign)
            touched = np.unique(self.places(own, value).ravel())
            look = touched[np.abs(self.count[touched]) == 1]
        full = np.concatenate(([0], np.cumsum((self.count != 0) | (self.key != 0) | (self.check != 0))))
        empty = full[self.base[1:]] == full[self.base[:-1]]
        parts = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((who, np.int64), (what, np.uint64), (signs, np.int64))]
        return parts[0], parts[1], parts[2], empty


def _chosen(digests: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in rows, digest) of the digests of some texts."""
    counts = at[rows + 1] - at[rows]
    who = np.repeat(np.arange(len(rows)), counts)
    place = np.repeat(at[rows], counts) + np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    return who, digests[place]


def _larger(cells: np.ndarray, total: np.ndarray) -> np.ndarray:
    if (cells > np.maximum(MOST, 64 * total)).any():
        raise ValueError("a sketch can't be peeled")
    return cells * GROWTH


def _slices(cells: np.ndarray, most: int = 1 << 21):
    """Runs of sketches with about `most` cells in all."""
    lo, ends = 0, np.cumsum(RANGES * cells)
    while lo < len(cells):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def sketched(every: tuple[np.ndarray, np.ndarray], n: int) -> tuple[list[str], np.ndarray]:
    """The fingerprints of the first n texts given as paragraphs(), and their cells: as many as peeling needs."""
    rows, out = np.arange(n), np.empty(n, object)
    cells = cells_for(np.diff(every[1])[:n])
    todo = rows
    while len(todo):
        stuck = []
        for lo, hi in _slices(cells[todo]):
            some = todo[lo:hi]
            made = Sketches(cells[some])
            made.add(*_chosen(*every, some), 1)
            _, _, _, empty = made.copy().peel()
            empty &= np.maximum.reduceat(made.count, made.base[:-1]) < 128
            out[some[empty]] = np.array(made.texts(), object)[empty]
            stuck.append(some[~empty])
        todo = np.concatenate(stuck)
        cells[todo] = _larger(cells[todo], np.diff(every[1])[todo])
    return out.tolist(), cells


def likeness(a: tuple[np.ndarray, np.ndarray], a_rows: np.ndarray, b: tuple[np.ndarray, np.ndarray], b_rows: np.ndarray) -> np.ndarray:
    """2 * common / all for pairs of texts given as paragraphs() and row numbers; 1 for two without paragraphs."""
    sizes = [x[1][rows + 1] - x[1][rows] for x, rows in ((a, a_rows), (b, b_rows))]
    total, out = sizes[0] + sizes[1], np.ones(len(a_rows))
    todo, cells = np.flatnonzero(total > 0), cells_for(np.maximum(*sizes))
    while len(todo):
        stuck = []
        for lo, hi in _slices(cells[todo]):
            some = todo[lo:hi]
            apart = Sketches(cells[some])
            apart.add(*_chosen(*a, a_rows[some]), 1)
            apart.add(*_chosen(*b, b_rows[some]), -1)
            pair, _, _, empty = apart.peel()
            differ = np.bincount(pair, minlength=len(some))
            out[some[empty]] = ((total[some] - differ) / total[some])[empty]
            stuck.append(some[~empty])
        todo = np.concatenate(stuck)
        cells[todo] = _larger(cells[todo], total[todo])
    return out


def difference(a: str, b: str) -> tuple[set[int], set[int], int]:
    """From two fingerprints: the paragraph digests that only a has, those that only b has, and how many both have."""
    one, two = Sketches.read([a]), Sketches.read([b])
    counts = [int(x.count.sum()) // RANGES for x in (one, two)]
    cells, apart = np.maximum(one.cells, two.cells), None
    if one.cells[0] == two.cells[0]:
        apart = one.copy()
        apart.count -= two.count
        apart.key ^= two.key
        apart.check ^= two.check
    while True:
        if apart is not None:
            _, value, sign, empty = apart.peel()
            if empty[0]:
                mine, theirs = set(value[sign > 0].tolist()), set(value[sign < 0].tolist())
                return mine, theirs, counts[0] - len(mine)
            cells = _larger(cells, np.array([sum(counts)]))
        apart = Sketches(cells)
        for side, sign in ((one, 1), (two, -1)):
            who, value, _, _ = side.copy().peel()
            apart.add(who, value, sign)


def near(a: str, b: str) -> float:
    """The likeness of two fingerprints, 0 to 1; 1 for two without paragraphs."""
    mine, theirs, both = difference(a, b)
    return 2 * both / (2 * both + len(mine) + len(theirs)) if both or mine or theirs else 1.0


def edited(text: str, following: str) -> str:
    """`text` with the last third of its code points replaced by as many from the
    start of the following text, or by all of it if it has fewer."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _ends(ids: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids that end about equal ranges of rows, the largest last, and how many ranges' rows each ends."""
    marks = [k / parts for k in range(1, parts)]
    row = ids.agg(
        F.percentile_approx("id", F.array(*map(F.lit, marks)) if marks else F.array(F.lit(0.5)), F.lit(10_000)).alias("ends"),
        F.max("id").alias("last"),
    ).first()
    ends = [*((row["ends"] or []) if marks else []), *([] if row["last"] is None else [row["last"]])]
    return np.unique(np.array(ends, np.int64), return_counts=True)


def with_range(rows: DataFrame, ends: np.ndarray, many: np.ndarray) -> DataFrame:
    """`rows` (id, hash and others) with k, the number of a row's range.  The ends
    stand in blocks of about the root of their number, which are searched in two
    steps.  An id that fills several ranges is cut by the hash of the text."""
    spark, wide = rows.sparkSession, int(np.ceil(np.sqrt(len(ends))))
    blocks_of = lambda x: [x[k : k + wide].tolist() for k in range(0, len(x), wide)]
    start = np.cumsum(many) - many
    marks = spark.createDataFrame(  # one row, a few numbers a range
        [(ends[wide - 1 :: wide].tolist(), blocks_of(ends), blocks_of(start), blocks_of(many))],
        "__tops array<long>, __ends array<array<long>>, __start array<array<long>>, __many array<array<long>>",
    )
    below = lambda ends: F.size(F.filter(ends, lambda end: end < F.col("id"))) + 1
    at = lambda name: F.element_at(F.element_at(name, F.col("__block")), F.col("__at"))
    part = F.shiftright(F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 32) * at("__many"), 32)
    rows = rows.crossJoin(F.broadcast(marks)).withColumn("__block", below("__tops")).withColumn("__at", below(F.element_at("__ends", F.col("__block"))))
    k = at("__start") + F.when(F.col("id") == at("__ends"), part).otherwise(0)
    return rows.withColumn("k", k.cast("int")).drop("__tops", "__ends", "__start", "__many", "__block", "__at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) for each row.

    The next document is the one with the next smaller id, and after the
    smallest the largest; among equal ids texts come in descending order of
    their xxhash64, and a null id comes after all others (before the first
    again).  A null text is empty; a very long text is sketched like any other,
    with cells in proportion.  A single row is its own next.  An empty table
    gives no rows; other columns are not read.

    Rows are dealt once, by ranges of ids; the first row of each range also
    goes to the range before it, so no task needs more than its range.  Only
    rows that repeat both id and text can't be parted.
    """
    spark = docs.sparkSession
    short_batches(spark)
    lowest = F.lit(-(1 << 63))  # a null id comes last
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc", lowest).alias("id"), "doc", "text")
    ends, many = _ends(rows.select("id"), shuffle_partitions(spark))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not len(ends):
        return spark.createDataFrame([], schema)
    rows = with_range(rows.withColumn("hash", F.xxhash64("text")), ends, many)
    # The first row of each range in descending order, a few numbers a range.
    tops = sorted((r.k, r.top.id, r.top.hash) for r in rows.groupBy("k").agg(F.max(F.struct("id", "hash")).alias("top")).collect())
    before = {k: tops[(i + 1) % len(tops)][0] for i, (k, _, _) in enumerate(tops)}  # ranges come in descending order
    lent = spark.createDataFrame([(k, i, h, before[k]) for k, i, h in tops], "k int, id long, hash long, before int")
    rows = rows.join(F.broadcast(lent), ["k", "id", "hash"], "left")
    here = F.struct(F.col("k").alias("to"), F.lit(0).alias("lent"))
    there = F.struct(F.col("before").alias("to"), F.lit(1).alias("lent"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    rows = rows.select(F.col("at.to").alias("to"), F.col("at.lent").alias("lent"), "id", "hash", "doc", "text")
    parts = int(many.sum())
    dealt = rows.repartitionById(parts, "to").sortWithinPartitions("to", "lent", F.desc("id"), F.desc("hash"), F.desc("text")).select("to", "lent", "doc", "text")

    def run(batches):
        held = None  # the row that waits for its next, and its range
        for batch in batches:
            pairs = []
            for to, lent, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    if held[0] != to:
                        raise ValueError("a range of ids has no row that follows it")
                    pairs.append((held[1], held[2], text))
                held = None if lent else (to, doc, text)
            if pairs:
                yield _compared(*zip(*pairs), names)

    return dealt.mapInArrow(run, schema)


def _compared(docs, own, following, names) -> pa.RecordBatch:
    n = len(own)
    new = [edited(t, f) for t, f in zip(own, following)]
    # the following text is mostly the next one of `own`
    next_at = np.array([k + 1 if k + 1 < n and own[k + 1] is following[k] else -1 for k in range(n)])
    extra = np.flatnonzero(next_at < 0)
    next_at[extra] = n + np.arange(len(extra))
    here = paragraphs([*own, *(following[k] for k in extra.tolist())])
    there = paragraphs(new)
    rows = np.arange(n)
    columns = [
        pa.array(docs, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(sketched(here, n)[0]), pa.array(sketched(there, n)[0]),
        pa.array(likeness(here, rows, there, rows)), pa.array(likeness(here, rows, here, next_at)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)
