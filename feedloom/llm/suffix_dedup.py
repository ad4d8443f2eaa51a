"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of `LENGTH` bytes that covers it starts somewhere else
too.  Every such string (a window) has an anchor: of its `CORE`-byte parts the one
with the least hash, the first of equals.  Equal windows have equal anchors at
equal places, so windows meet where their anchors' bytes, the core, meet; and the
windows of one anchor lie side by side, so a text is cut into short strings (all
windows of an anchor) that are about anchors, not about positions.

1. Texts are stored in portions (rows of about `PORTION` bytes) with their anchors.
2. Each portion sends one row for each different core: its hash, a digest of the
   strings around it, how many.  Cores that occur once in the corpus end here: no
   window of theirs is repeated.  Strings that are equal as a whole are one string
   with a weight; where a core has no other string, all its windows are repeated.
3. Strings of cores with several go to the core's task, less the core itself, for
   which one symbol stands.  There they are put into shards; a shard's strings have
   a Burrows-Wheeler transform of their own.  The transforms are merged: the order
   in which shards alternate is refined round by round, each round a stable sort
   by preceding symbols of the order before, and round h leaves rows in one block
   that agree in h symbols (the boundary between two rows appears in the round
   after their common prefix).  After as many rounds as a window has symbols, blocks
   with weight over one are the repeated intervals.  No suffixes are sorted again.
4. A mask of repeated windows for each string goes back to its portions.

A core with over `HOT` strings (a very common passage in ever other surroundings)
is split: its windows are dealt by their offset in cells of `CELL`, and a cell's
core is what all its windows share, nearly all of a window; so other surroundings
part, and the strings of a cell vary in a few bytes only.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import drop_stored, short_batches, shuffle_partitions, stored, stored_by
from feedloom.llm.packed import opened, pack, portions, sealed, sliced, unpack, whole
from feedloom.llm.text import BASE, Powers, U64, mix, raw, slice_hashes

LENGTH = 200
#: Windows that may share an anchor, one more than the bytes of a window outside its core.
SHARE = 51
PORTION = 4 << 20
#: Windows that are looked at together.
PIECE = 1 << 18
#: Occurrences of a core (at most 127 counted a portion) from which it is split, and offsets in a cell.
HOT, CELL = 1024, 8
#: Rows that a task gathers, and symbols that are merged together, in how many shards.
CORE_ROWS, STRING_ROWS, SYMBOLS, SHARDS = 1 << 20, 1 << 17, 1 << 18, 4
#: Ways of a core: all its windows are repeated; several strings; several strings, split.
ALL, SEVERAL, SPLIT = 1, 2, 3
#: Another byte for each byte, for a second hash.
OTHER = ((np.arange(256) * 167 + 89) % 256).astype(np.uint8)


# -- anchors ----------------------------------------------------------------------


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, share: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): anchors of the windows of texts in `buf` and the starts of
    the first and last window of each."""
    core, n = length - share + 1, len(buf)
    found = []
    bits = U64(PIECE + share).item().bit_length()
    low = U64((1 << bits) - 1)
    for base in range(0, n - length + 1, PIECE):
        windows = min(PIECE, n - length + 1 - base)
        m = windows + share - 1  # parts that these windows have
        up, down = powers.of(m + core + 1)
        sums = np.zeros(m + core, U64)
        np.cumsum((buf[base : base + m + core - 1].astype(U64) + U64(1)) * up[: m + core - 1], out=sums[1:])
        h = mix((sums[core : core + m] - sums[:m]) * down[:m])
        least = (h & ~low) | np.arange(m, dtype=U64)
        span = 1
        while span < share:  # least of `span` neighbours, then of more
            step = min(span, share - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        found.append((least & low).astype(np.int64) + base)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place = np.concatenate(found)
    inside = np.zeros(n + 1, np.int64)  # windows that begin in a text and end there
    long = np.diff(offs) >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(place)]) > 0)
    place = place[starts]
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    last = np.append(new[1:], True)[: len(new)]
    return place[new], starts[new], starts[last]


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of slices in any order."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], ends[order]
    if (np.diff(e) < 0).any():
        raise ValueError("a slice lies inside another")
    out = np.empty(len(starts), U64)
    out[order] = slice_hashes(buf, s, e, powers)
    return out


class Strings:
    """Strings around cores: bytes from `start` to `end`, the core within them, the key
    that strings with this core share, a second hash of the core and a digest."""

    def __init__(self, buf, other, powers, start, core, core_end, end, salt) -> None:
        self.start, self.core, self.core_end, self.end = start, core, core_end, end
        self.key = hashed(buf, core, core_end, powers)
        if salt is not None:
            self.key = mix(self.key + salt.astype(U64) + U64(1))
        self.second = hashed(other, core, core_end, powers)
        self.digest = mix(hashed(other, start, end, powers) + (core - start).astype(U64))

    def code(self) -> np.ndarray:
        return code(self.key, self.digest)


def code(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """One number for a key and a digest, within a portion."""
    return mix(key * U64(BASE) + digest)


def plain_strings(buf, other, powers, place, first, last, length, share) -> Strings:
    """One string for each anchor."""
    return Strings(buf, other, powers, first, place, place + length - share + 1, last + length, None)


def split_strings(buf, other, powers, place, first, last, length, share) -> tuple[np.ndarray, Strings]:
    """A string for each cell of an anchor's windows; the anchor of each."""
    of, parts = [], []
    for c in range(-(-share // CELL)):
        core = place - c * CELL
        lo, hi = np.maximum(first, core - CELL + 1), np.minimum(last, core)
        have = np.flatnonzero(lo <= hi)
        of.append(have)
        parts.append((lo[have], core[have], core[have] - CELL + 1 + length, hi[have] + length, np.full(len(have), c)))
    start, core, core_end, end, cell = (np.concatenate(x) for x in zip(*parts))
    of = np.concatenate(of)
    order = np.lexsort((end, start))
    start, core, core_end, end, cell, of = (x[order] for x in (start, core, core_end, end, cell, of))
    return of, Strings(buf, other, powers, start, core, core_end, end, cell)


# -- transforms -------------------------------------------------------------------


def transform(symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of strings by their first `depth` symbols, and the
    symbol before each.  Each string ends in a zero, at `ends`, which also stands
    before its start; ranks double from round to round."""
    n = len(symbols)
    end = np.repeat(ends, np.diff(ends, prepend=-1))
    rank = symbols.astype(np.int64) + 1
    h = 1
    while h < depth:
        step = min(h, depth - h)
        at = np.arange(n) + step
        key = (rank << 32) | np.where(at <= end, rank[np.minimum(at, n - 1)], 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        h += step
    order = np.argsort(rank, kind="stable")
    before = np.concatenate(([0], symbols[:-1]))
    before[np.concatenate(([0], ends[:-1] + 1))] = 0
    return order, before[order].astype(np.uint16)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all rows of several transforms, as the transform that each comes
    from, and the common prefix of each row with the row before it, up to `depth`.

    A round takes the order by h symbols to that by h + 1: rows are put in the order
    of the symbol before them, else as they stand.  What it makes is where the rows
    of each transform go, as each keeps its own order.  It ends early once no block
    of equal prefixes was parted, as then none ever will be."""
    n = sum(map(len, transforms))
    origin = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    prefix = np.full(n, depth, np.int32)
    prefix[:1] = 0
    block = np.zeros(n, np.int32)
    known = np.zeros(n, bool)
    known[:1] = True
    before = np.empty(n, np.uint16)
    for h in range(depth):
        for k, t in enumerate(transforms):
            before[origin == k] = t
        order = np.argsort(before, kind="stable")
        origin, block, symbol = origin[order], block[order], before[order]
        parted = np.ones(n, bool)
        parted[1:] = (symbol[1:] != symbol[:-1]) | ((block[1:] != block[:-1]) & (symbol[1:] != 0))
        new = parted & ~known
        prefix[new] = h
        block = np.cumsum(parted, dtype=np.int32)
        if not new.any():
            break
        known = parted
    return origin, prefix


def repeated(strings: list[np.ndarray], weights: np.ndarray, shard: np.ndarray, depth: int) -> np.ndarray:
    """For each string of symbols (over zero) a mask of the starts from which its next
    `depth` symbols also begin elsewhere, or in a string with a weight over one."""
    sizes = np.array([len(s) for s in strings])
    orders, transforms, owners, places = [], [], [], []
    for k in range(int(shard.max()) + 1):
        own = np.flatnonzero(shard == k)
        if len(own) == 0:
            continue
        symbols = np.concatenate([x for i in own.tolist() for x in (strings[i], [0])]).astype(np.uint16)
        ends = np.cumsum(sizes[own] + 1) - 1
        order, before = transform(symbols, ends, depth)
        owner = np.repeat(own, sizes[own] + 1)
        place = np.arange(len(symbols)) - np.repeat(ends - sizes[own], sizes[own] + 1)
        transforms.append(before)
        owners.append(owner[order])
        places.append(place[order])
    origin, prefix = merge(transforms, depth)
    owner, place = np.empty(len(origin), np.int64), np.empty(len(origin), np.int64)
    for k in range(len(transforms)):
        owner[origin == k], place[origin == k] = owners[k], places[k]
    interval = np.cumsum(prefix < depth)
    full = place + depth <= sizes[owner]
    weight = np.bincount(interval[full], weights[owner[full]], int(interval[-1]) + 1)
    hit = np.flatnonzero(full)
    hit = hit[weight[interval[hit]] > 1]
    mask = np.zeros(len(strings), U64)
    np.bitwise_or.at(mask, owner[hit], U64(1) << place[hit].astype(U64))
    return mask


# -- steps ------------------------------------------------------------------------

TABLE = "portion long, ids binary, sizes binary, bytes binary, anchors binary"


def text_portions(docs: DataFrame, length: int, share: int) -> DataFrame:
    """The stored portions, dealt into files by portion so that what is sent to portions
    meets them without moving texts."""

    def run(batches):
        powers = Powers()
        for key, ids, texts in portions(batches, PORTION):
            buf, offs = raw(texts)
            found = anchors(buf, offs, length, share, powers)
            row = (key, sealed(pa.RecordBatch.from_arrays([ids], names=["doc_id"])), pack(np.diff(offs)), buf.tobytes(), pack(*(x.astype(U64) for x in found)))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 4))], names=["portion", "ids", "sizes", "bytes", "anchors"])

    return stored_by(docs.mapInArrow(run, TABLE), "portion", shuffle_partitions(docs.sparkSession), block_bytes=16 << 20)


def _opened(data: bytes, sizes: bytes, found: bytes):
    place, first, last = (x.astype(np.int64) for x in unpack(found))
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(unpack(sizes)[0]))), place, first, last


def core_ways(table: DataFrame, length: int, share: int) -> DataFrame:
    """(portion, found, strings): the stored list of the repeated cores of each portion
    with their ways, and how many strings it will send."""
    parts = max(shuffle_partitions(table.sparkSession), table.agg(F.count(F.lit(1))).first()[0] // 8)

    def sent(batches):
        powers = Powers()
        for batch in batches:
            for portion, data, found in zip(*(c.to_pylist() for c in batch.columns)):
                place, first, last = (x.astype(np.int64) for x in unpack(found))
                buf = np.frombuffer(data, np.uint8)
                x = plain_strings(buf, OTHER[buf], powers, place, first, last, length, share)
                order = np.argsort(x.key, kind="stable")
                key, digest = x.key[order], x.digest[order] >> U64(8)
                if len(key) == 0:
                    continue
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                least, most = np.minimum.reduceat(digest, at), np.maximum.reduceat(digest, at)
                many = np.minimum(np.diff(np.append(at, len(key))), 127).astype(U64)
                # The digest has 56 bits here, beside the core's 64.
                about = (least << U64(8)) | (many << U64(1)) | (least != most).astype(U64)
                yield from sliced({"core": key[at].view(np.int64), "portion": np.full(len(at), portion), "about": about.view(np.int64)})

    def added(batches):
        core, portion, about = whole(batches, 3)
        order = np.argsort(core, kind="stable")
        core, portion, about = core[order], portion[order], about[order].view(U64)
        if len(core) == 0:
            return
        at = np.flatnonzero(np.concatenate(([True], core[1:] != core[:-1])))
        digest = about >> U64(8)
        total = np.add.reduceat((about >> U64(1)) & U64(127), at)
        several = (np.minimum.reduceat(digest, at) != np.maximum.reduceat(digest, at)) | (np.add.reduceat(about & U64(1), at) > 0)
        way = np.where(total < 2, 0, np.where(~several, ALL, np.where(total < HOT, SEVERAL, SPLIT)))
        rows = np.repeat(way, np.diff(np.append(at, len(core))))
        keep = rows > 0
        yield from sliced({"core": core[keep], "portion": portion[keep], "way": rows[keep]})

    def listed(batches):
        core, portion, way = whole(batches, 3)
        order = np.lexsort((core.view(U64), portion))
        core, portion, way = core[order], portion[order], way[order]
        at = np.append(np.flatnonzero(np.concatenate(([True], portion[1:] != portion[:-1]))), len(core)) if len(core) else np.zeros(1, np.int64)
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            n = int((way[a:z] == SEVERAL).sum() + (way[a:z] == SPLIT).sum() * (share // CELL + 1))
            row = (int(portion[a]), pack(core[a:z].view(U64), way[a:z].astype(np.int8)), n)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["portion", "found", "strings"])

    rows = table.select("portion", "bytes", "anchors").mapInArrow(sent, "core long, portion long, about long")
    # A portion has an anchor for each twentieth or so of its bytes.
    wide = max(shuffle_partitions(table.sparkSession), parts * 8 * (PORTION // 20) // CORE_ROWS)
    ways = rows.repartition(wide, "core").mapInArrow(added, "core long, portion long, way long")
    return stored(ways.repartition(parts, "portion").mapInArrow(listed, "portion long, found binary, strings long"))


def _ways(key: np.ndarray, found: bytes | None) -> np.ndarray:
    """The way of each core; 0 if it is not repeated."""
    out = np.zeros(len(key), np.int64)
    if found:
        cores, way = unpack(found)
        at = np.minimum(np.searchsorted(cores, key), len(cores) - 1)
        out = np.where(cores[at] == key, way[at], 0)
    return out


def _sent_strings(buf, other, powers, place, first, last, way, length, share):
    """(way, anchors, Strings) for the anchors whose strings are sent."""
    for kind in (SEVERAL, SPLIT):
        own = np.flatnonzero(way == kind)
        if len(own):
            some = (place[own], first[own], last[own], length, share)
            if kind == SEVERAL:
                yield kind, own, plain_strings(buf, other, powers, *some)
            else:
                of, x = split_strings(buf, other, powers, *some)
                yield kind, own[of], x


def masks(table: DataFrame, lists: DataFrame, length: int, share: int) -> DataFrame:
    """(portion, key, digest, mask) of strings that have repeated windows."""
    spark = table.sparkSession
    parts = max(shuffle_partitions(spark), lists.agg(F.coalesce(F.sum("strings"), F.lit(0))).first()[0] // STRING_ROWS)
    names = ["key", "second", "digest", "portion", "n", "way", "left", "right"]

    def sent(batches):
        powers = Powers()
        for batch in batches:
            for portion, data, found, listed in zip(*(c.to_pylist() for c in batch.columns)):
                place, first, last = (x.astype(np.int64) for x in unpack(found))
                buf = np.frombuffer(data, np.uint8)
                other = OTHER[buf]
                way = _ways(hashed(buf, place, place + length - share + 1, powers), listed)
                for kind, _, x in _sent_strings(buf, other, powers, place, first, last, way, length, share):
                    _, at, many = np.unique(x.code(), return_index=True, return_counts=True)
                    for lo in range(0, len(at), 1 << 16):
                        some = at[lo : lo + (1 << 16)]
                        left, right = ([data[a:z] for a, z in zip(s[some].tolist(), e[some].tolist())] for s, e in ((x.start, x.core), (x.core_end, x.end)))
                        columns = [x.key[some].view(np.int64), x.second[some].view(np.int64), x.digest[some].view(np.int64), np.full(len(some), portion), many[lo : lo + (1 << 16)], np.full(len(some), kind)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=names)

    def merged(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        columns = [pa.concat_arrays([b.column(i) for b in rows]) for i in range(8)]
        key, second, digest, portion, n, way = (np.asarray(c) for c in columns[:6])
        order = np.lexsort((portion, digest, second, key, way))
        k, s, d, w = key[order], second[order], digest[order], way[order]
        core = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])))
        string = core | np.concatenate(([True], d[1:] != d[:-1]))
        at = np.flatnonzero(string)
        weight = np.add.reduceat(n[order], at)
        group = (np.cumsum(core) - 1)[at]
        in_group = np.bincount(group)[group]
        mask = np.zeros(len(at), U64)
        left, right = (c.take(pa.array(order[at])) for c in columns[6:])
        (lbuf, loff), (rbuf, roff) = raw(left), raw(right)
        sizes = np.diff(loff) + np.diff(roff) + 1
        depth = np.where(w[at] == SEVERAL, share, CELL)
        # A string that is alone and occurs again has all its windows repeated.
        alone = (in_group == 1) & (weight > 1)
        windows = (sizes - depth + 1).astype(U64)
        mask[alone] = ~U64(0) >> (U64(64) - windows[alone])
        todo = np.flatnonzero(in_group > 1)
        shard = (portion[order][at] % SHARDS).astype(np.int64)
        # Whole groups are merged together, as many as have about SYMBOLS symbols.
        ends = np.cumsum(sizes[todo] + 1)
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SYMBOLS, "right")))
            while hi < len(todo) and (group[todo[hi]] == group[todo[hi - 1]] and depth[todo[hi]] == depth[todo[hi - 1]]):
                hi += 1
            change = np.flatnonzero(depth[todo[lo:hi]] != depth[todo[lo]])
            hi = lo + int(change[0]) if len(change) else hi
            some = todo[lo:hi]
            base = group[some[0]]
            strings = []
            for i in some.tolist():
                middle = [257 + group[i] - base]
                strings.append(np.concatenate((lbuf[loff[i] : loff[i + 1]].astype(np.uint16) + 1, middle, rbuf[roff[i] : roff[i + 1]].astype(np.uint16) + 1)))
            mask[some] = repeated(strings, weight[some], shard[some], int(depth[some[0]]))
            lo = hi
        of = np.cumsum(string) - 1
        keep = mask[of] > 0
        yield from sliced({"portion": portion[order][keep], "key": k[keep], "digest": d[keep], "mask": mask[of][keep].view(np.int64)})

    joined = table.select("portion", "bytes", "anchors").join(lists.select("portion", "found").hint("shuffle_hash"), "portion")
    rows = joined.select("portion", "bytes", "anchors", "found").mapInArrow(sent, "key long, second long, digest long, portion long, n long, way long, left binary, right binary")
    return rows.repartition(parts, "key").mapInArrow(merged, "portion long, key long, digest long, mask long")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, share: int = SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): for each row its bytes, those
    removed, the removed runs (starts and ends in bytes) and the bytes that stay.

    A byte is removed if some `length` bytes of its row cover it that start anywhere
    else too, in any row; matches don't cross rows.  A null text is empty; null ids,
    repeated ids and repeated rows are rows like any other, so copies go whole if they
    are long enough; a very long text is a portion of its own; overlapping occurrences
    count; an empty table gives no rows.  Other columns are not read.  `share` (2 to
    64, under `length`) sets how many windows may have one anchor.
    """
    if not 1 <= share <= min(64, length):
        raise ValueError("share must be from 1 to 64 and at most the length")
    spark = docs.sparkSession
    short_batches(spark)
    table = text_portions(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), length, share)
    lists = core_ways(table, length, share)
    back = masks(table, lists, length, share).groupBy("portion").agg(F.collect_list(F.struct("key", "digest", "mask")).alias("masks"))
    found = stored(lists.select("portion", "found").join(back, "portion", "left"), block_bytes=16 << 20)
    drop_stored(lists)

    def run(batches):
        powers = Powers()
        for batch in batches:
            column = batch.column(5)
            for k, (ids, sizes, data, places, listed) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                buf, offs, place, first, last = _opened(data, sizes, places)
                start, end = _covered(buf, powers, place, first, last, listed, column[k].values, length, share)
                yield _kept(opened(ids).column(0), buf, offs, start, end)

    rows = table.join(found.hint("shuffle_hash"), "portion", "left")
    return rows.select("ids", "sizes", "bytes", "anchors", "found", "masks").mapInArrow(run, RESULT)


def _covered(buf, powers, place, first, last, listed, masks, length: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that are to go; they may overlap."""
    starts, ends = [], []
    if listed:
        way = _ways(hashed(buf, place, place + length - share + 1, powers), listed)
        every = way == ALL
        starts.append(first[every])
        ends.append(last[every] + length)
        if masks is not None and len(masks):
            key, digest, mask = (np.asarray(masks.field(i)).view(U64) for i in range(3))
            codes = code(key, digest)
            order = np.argsort(codes)
            codes, mask = codes[order], mask[order]
            for _, _, x in _sent_strings(buf, OTHER[buf], powers, place, first, last, way, length, share):
                own = x.code()
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                hit = codes[at] == own
                begin, bits = x.start[hit], mask[at[hit]]
                for b in range(share):
                    on = begin[(bits >> U64(b)) & U64(1) > 0] + b
                    starts.append(on)
                    ends.append(on + length)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))


def _kept(ids: pa.Array, buf, offs, start, end) -> pa.RecordBatch:
    n = len(buf)
    gone = np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(end, minlength=n + 1)[:n]) > 0
    before = np.zeros(n, bool)
    before[1:] = gone[:-1]
    after = np.zeros(n, bool)
    after[:-1] = gone[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = False
    after[inner - 1] = False
    heads, tails = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    at = np.searchsorted(heads, offs)
    base = np.repeat(offs[:-1], np.diff(at))
    spans = pa.StructArray.from_arrays([pa.array(heads - base), pa.array(tails - base)], names=["start", "end"])
    removed = np.concatenate(([0], np.cumsum(gone)))[offs]
    left = np.ascontiguousarray(buf[~gone])
    kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((offs - removed).astype(np.int32)), pa.py_buffer(left)])
    columns = [ids, pa.array(np.diff(offs)), pa.array(np.diff(removed)), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans), kept]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")])
