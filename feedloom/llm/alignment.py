"""Links between the tokens of two tokenizers by products of sparse incidence matrices.

Tokens of either tokenizer cover the bytes of a text without gap, so a matrix of
tokens and bytes (A, and B of the other tokenizer) has a one where a token covers
a byte.  Row products A·Bᵀ (Gustavson: a row of the product is the sum of the rows
of Bᵀ that the row of A names) are the overlaps, with the bytes shared.  Where
both the A and the B token change from one overlap to the next, both end, and a
new group begins.  The incidence of tokens and groups, multiplied the same way,
links all A tokens of a group with all its B tokens; equal ids of a group are one
row with a value there, so a long run in which the tokenizers stay out of step
takes as many cells as it has different ids.

A text is cut into units before single spaces that a non-space follows.  Neither
tokenizer joins characters across such a place (the piece vocabulary is examined
for that; the byte-level pattern starts a new part there), so the tokens, groups
and links of a text are those of its units, one after the other, and each
different unit of a portion (texts of about `PORTION` bytes) is encoded and
multiplied once.  Portions are stored rows: their texts' units and their units'
links.  A portion sends one row for each different id pair with the number of
its texts that have it; the sums go back to it, and linear sums over units give
the figures of each text.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Sent, short_batches, shuffle_partitions, stored
from feedloom.llm.packed import opened, pack, portions, sealed, sliced, unpack, whole
from feedloom.llm.text import Powers, raw, slice_hashes

#: Bytes of text in a portion, units encoded at once, and rows of pairs in a task that adds them up.
PORTION, ENCODED, PAIR_ROWS = 3 << 20, 1 << 12, 1 << 20
#: Cells that a panel of rows of a product may have before they are summed.
PANEL = 1 << 19
#: Units that a worker remembers at most; beyond that it begins again.
KNOWN = 1 << 18
#: No unit begins before a space that one of these bytes follows: ASCII white space
#: and the first bytes of all other white space in UTF-8.
STAYS = np.zeros(256, bool)
STAYS[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


# -- sparse matrices --------------------------------------------------------------


class Csr:
    """Rows of column numbers and values: row r has those from ptr[r] to ptr[r + 1]."""

    def __init__(self, ptr: np.ndarray, columns: np.ndarray, values: np.ndarray | None = None) -> None:
        self.ptr, self.columns = ptr, columns
        self.values = np.ones(len(columns), np.int64) if values is None else values

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray | None, n: int) -> "Csr":
        """From cells that stand in the order of their rows."""
        return cls(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), columns, values)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, counts[i] of them, for each i."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order and the sums of their values."""
    if len(keys) == 0:
        return keys, values
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def product(a: Csr, b: Csr) -> Csr:
    """a·b by Gustavson's rows: each row of `a` adds up the rows of `b` that it names.
    Rows are taken in panels, so the cells before their sum stay bounded."""
    each = b.ptr[a.columns + 1] - b.ptr[a.columns]
    work = np.concatenate(([0], np.cumsum(each)))[a.ptr]
    n, lo, found = len(a.ptr) - 1, 0, []
    row_of = a.rows()
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + PANEL, "right")) - 1)
        s, e = a.ptr[lo], a.ptr[hi]
        at = spread(b.ptr[a.columns[s:e]], each[s:e])
        keys = (np.repeat(row_of[s:e], each[s:e]) << 32) | b.columns[at]
        found.append(summed(keys, np.repeat(a.values[s:e], each[s:e]) * b.values[at]))
        lo = hi
    keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.int64)
    return Csr.of(keys >> 32, keys & 0xFFFFFFFF, values, n)


def overlaps(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Csr:
    """A·Bᵀ of the incidences of tokens and bytes: bytes shared by A and B tokens
    that cover the same bytes, given the bytes of each token."""
    n = int(sizes_a.sum())
    a = Csr(np.concatenate(([0], np.cumsum(sizes_a))), np.arange(n))
    return product(a, Csr(np.arange(n + 1), np.repeat(np.arange(len(sizes_b)), sizes_b)))


def groups(links: Csr, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A token and of each B token: where both change, both have ended."""
    i, j = links.rows(), links.columns
    new = np.zeros(len(i), np.int64)
    new[1:] = (i[1:] != i[:-1]) & (j[1:] != j[:-1])
    group = np.cumsum(new)
    of_b = np.zeros(n_b, np.int64)
    of_b[j] = group
    return group[links.ptr[:-1]], of_b


def shared(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, links): product of the incidences of ids and groups."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    key_a, many_a = summed((group_a << 32) | ids_a, np.ones(len(ids_a), np.int64))
    key_b, many_b = summed((group_b << 32) | ids_b, np.ones(len(ids_b), np.int64))
    a = Csr(np.arange(len(key_a) + 1), key_a >> 32, many_a)
    links = product(a, Csr.of(key_b >> 32, key_b & 0xFFFFFFFF, many_b, n))
    of = links.rows()
    return key_a[of] >> 32, key_a[of] & 0xFFFFFFFF, links.columns, links.values


# -- tokenizers -------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands
    for itself, the others for what follows code point 255, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, with the bytes of each of their ids.

    `byte_bpe` is a byte-level tokenizer as JSON; `piece_bpe` a model of pieces that
    puts a space before the text."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        #: Whether no piece goes on after a space in its middle, so that texts may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        n, m = len(self.bytes_a), len(self.bytes_b)
        ends = [(",", n), ("|", n), (",", m), (";", m)]
        self.said = [f"{k}{end}" for end, many in ends for k in range(many)]
        self.said_sizes = np.array([len(s) for s in self.said], np.int64)
        self.known: dict[bytes, tuple[list[int], list[int]]] = {}

    def encode(self, units: list[bytes], often: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that begin with a space; those that a portion has more than once
        (`often`) are remembered for the next ones."""
        known, repeats = self.known, (often > 1).tolist()
        out = list(map(known.get, units))
        new = [k for k, both in enumerate(out) if both is None]
        for lo in range(0, len(new), ENCODED):
            some = new[lo : lo + ENCODED]
            texts = [units[k].decode("utf-8", "replace") for k in some]
            ids = zip((x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)), self.b.encode([t[1:] for t in texts], num_threads=1))
            for k, both in zip(some, ids):
                out[k] = both
                if repeats[k] and len(units[k]) < 64:
                    known[units[k]] = both
        if len(known) > KNOWN:
            known.clear()
        return [a for a, _ in out], [b for _, b in out]


# -- portions ---------------------------------------------------------------------


def units_of(texts: pa.Array, powers: Powers, cuts: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Different units of texts that are not empty, with a space put before each, and how
    often each occurs; the unit at each place, and the places before each text, then all."""
    buf, offs = raw(texts)
    buf, offs = np.insert(buf, offs[:-1], 32), offs + np.arange(len(offs))
    start = np.zeros(len(buf), bool)
    if cuts and len(buf) > 2:
        start[1:-1] = (buf[1:-1] == 32) & (buf[:-2] != 32) & ~STAYS[buf[2:]]
    start[offs[:-1]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(buf))
    _, first, unit, often = np.unique(slice_hashes(buf, starts, ends, powers), return_index=True, return_inverse=True, return_counts=True)
    data = buf.tobytes()
    return [data[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())], often, unit, np.searchsorted(starts, offs)


class Aligned:
    """Tokens, groups and links of different units."""

    def __init__(self, pair: Pair, units: list[bytes], often: np.ndarray) -> None:
        lists = pair.encode(units, often)
        self.ok = np.ones(len(units), bool)
        all_of = b"".join(units)
        if any(b"".join([table[i] for x in every for i in x]) != all_of for table, every in zip((pair.bytes_a, pair.bytes_b), lists)):
            for k, (unit, a, b) in enumerate(zip(units, *lists)):
                if b"".join([pair.bytes_a[i] for i in a]) != unit or b"".join([pair.bytes_b[i] for i in b]) != unit:
                    self.ok[k] = False
                    lists[0][k] = lists[1][k] = []
        (self.n_a, a), (self.n_b, b) = ((np.array([len(x) for x in every], np.int64), np.array([i for x in every for i in x], np.int64)) for every in lists)
        n = len(units)
        of_a, of_b = groups(overlaps(pair.sizes_a[a], pair.sizes_b[b]), len(b))
        unit_of = np.zeros(int(of_a[-1]) + 1 if len(a) else 0, np.int64)
        unit_of[of_a] = np.repeat(np.arange(n), self.n_a)
        self.n_groups = np.bincount(unit_of, minlength=n)
        self.said = self._said(pair, a, b, of_a, of_b, len(unit_of))
        group, id_a, id_b, many = shared(of_a, a, of_b, b)
        self.n_links = np.bincount(unit_of[group], many, n).astype(np.int64)
        self.pairs, at = np.unique((id_a.astype(np.uint64) << np.uint64(32)) | id_b.astype(np.uint64), return_inverse=True)
        key, many = summed((unit_of[group] << 32) | at, many)
        self.links = Csr.of(key >> 32, key & 0xFFFFFFFF, many, n)

    def _said(self, pair: Pair, a, b, of_a, of_b, n: int) -> list[bytes]:
        """Groups of each unit as decimal ids, with a semicolon at the end."""
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[of_b]
        last_a, last_b = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (of_a, of_b))
        code = np.zeros(len(a) + len(b), np.int64)
        code[at_a] = a + len(pair.bytes_a) * last_a
        code[at_b] = b + 2 * len(pair.bytes_a) + len(pair.bytes_b) * last_b
        text = "".join([pair.said[k] for k in code.tolist()]).encode()
        ends = np.concatenate(([0], np.cumsum(pair.said_sizes[code])))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        return [text[x:y] for x, y in zip(ends, ends[1:])]


DOCS = ["n_a", "n_b", "n_groups", "n_links"]
TABLE = "portion long, docs binary, units binary, links binary, pairs binary, n_pairs long"


def aligned_portions(docs: DataFrame, sent: Sent) -> DataFrame:
    """The stored table of portions.  `docs` has a row a text, with its own figures;
    `units` the different units of each text and how often, `links` the places of id
    pairs for each unit and how often, `pairs` the sorted pairs (A id << 32 | B id)
    and how many of the texts have each."""

    def run(batches):
        pair, powers = Pair(*sent.value), Powers()
        for key, ids, texts in portions(batches, PORTION):
            texts = texts.cast(pa.large_binary()).fill_null(b"")
            full = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 0)
            units, often, unit, at = units_of(texts.take(pa.array(full)), powers, pair.cuts)
            x = Aligned(pair, units, often)
            text_of = np.repeat(np.arange(len(full)), np.diff(at))
            good = np.bincount(text_of, ~x.ok[unit], len(full)) == 0 if len(full) else np.zeros(0, bool)
            keep = good[text_of]
            unit, text_of = unit[keep], text_of[keep]
            cells, often = summed(np.sort((text_of.astype(np.int64) << 32) | unit), np.ones(len(unit), np.int64))
            held = Csr.of(cells >> 32, cells & 0xFFFFFFFF, often, len(full))
            columns = {}
            for name in DOCS:
                column = np.zeros(len(ids), np.int64)
                # Weights of bincount are doubles, which hold these sums exactly up to 2**53.
                column[full] = np.bincount(text_of, getattr(x, name)[unit], len(full)) if name != "n_links" else _sums(held, x.n_links)
                columns[name] = pa.array(column)
            hashes = [""] * len(ids)
            bounds = np.searchsorted(text_of, np.arange(len(full) + 1)).tolist()
            listed = unit.tolist()
            for k in np.flatnonzero(good).tolist():
                hashes[full[k]] = hashlib.sha256(b"".join([x.said[u] for u in listed[bounds[k] : bounds[k + 1]]])[:-1]).hexdigest()
            have = product(held, Csr(x.links.ptr, x.links.columns))
            many = np.bincount(have.columns, minlength=len(x.pairs)).astype(np.int32)
            all_docs = pa.RecordBatch.from_arrays([ids, *columns.values(), pa.array(hashes), pa.array(_row_of(full, len(ids)))], names=["doc_id", *DOCS, "groups_sha256", "at"])
            row = (key, sealed(all_docs), _cells(held), _cells(x.links), pack(x.pairs, many), len(x.pairs))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["portion", "docs", "units", "links", "pairs", "n_pairs"])

    return stored(docs.mapInArrow(run, TABLE), block_bytes=16 << 20)


def _row_of(full: np.ndarray, n: int) -> np.ndarray:
    """For each row its place among texts that are not empty, or -1."""
    out = np.full(n, -1, np.int64)
    out[full] = np.arange(len(full))
    return out


def _sums(cells: Csr, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each row, in whole numbers."""
    totals = np.concatenate(([0], np.cumsum(cells.values * weights[cells.columns])))
    return totals[cells.ptr[1:]] - totals[cells.ptr[:-1]]


def _cells(x: Csr) -> bytes:
    return pack(np.diff(x.ptr).astype(np.int32), x.columns.astype(np.int32), x.values.astype(np.int64))


def _from_cells(data: bytes) -> Csr:
    counts, columns, values = unpack(data)
    return Csr(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), columns.astype(np.int64), values)


def pair_totals(table: DataFrame) -> DataFrame:
    """(portion, pair, n): for each pair of a portion the texts of all portions that have it."""
    rows = table.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(table.sparkSession), -(-rows // PAIR_ROWS))

    def sent(batches):
        for batch in batches:
            for portion, data in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, many = unpack(data)
                yield from sliced({"portion": np.full(len(pairs), portion), "pair": pairs.view(np.int64), "n": many.astype(np.int64)})

    def added(batches):
        portion, pair, n = whole(batches, 3)
        different, at = np.unique(pair, return_inverse=True)
        total = np.bincount(at, n, len(different)).astype(np.int64)
        yield from sliced({"portion": portion, "pair": pair, "n": total[at] if len(at) else n})

    schema = "portion long, pair long, n long"
    return stored(table.select("portion", "pairs").mapInArrow(sent, schema).repartition(parts, "pair").mapInArrow(added, schema))


def tokenizers(byte_bpe: str, piece_bpe: str) -> tuple[str, bytes]:
    """Both files, read on the driver and sent to workers, who need not have them."""
    with open(byte_bpe, encoding="utf-8") as a, open(piece_bpe, "rb") as b:
        json.loads(data := a.read())
        return data, b.read()


def pair_counts(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, n_docs): all linked id pairs and how many texts have them linked."""
    short_batches(docs.sparkSession)
    table = aligned_portions(_texts(docs, id_col, text_col), Sent(docs.sparkSession, tokenizers(byte_bpe, piece_bpe)))
    return pair_totals(table).groupBy("pair").agg(F.max("n").alias("n_docs")).select(F.shiftright("pair", 32).alias("id_a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("id_b"), "n_docs")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    A is the byte-level tokenizer file `byte_bpe`, B the piece model `piece_bpe`; both
    encode a space and the text.  Groups are cut where both have a token's end; links
    are all A-B token pairs of a group; the count of an id pair is the number of rows
    that have it linked; n_best counts the links whose pair has the highest count of
    its A id (all that tie).  Null and empty texts, and texts that the tokens do not
    spell byte by byte (as with U+2581), have zeros and no hash, and link nothing.
    (A tokenizer here may shorten what it reads, never lengthen it, so a text is spelt
    if each of its units is.)  Null ids, repeated ids and repeated rows are rows like
    any other and count each; a very long text is a portion of its own; an empty
    table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    table = aligned_portions(_texts(docs, id_col, text_col), Sent(spark, tokenizers(byte_bpe, piece_bpe)))
    totals = pair_totals(table)
    # At most one row for each id of A's vocabulary.
    tops = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect()
    highest = np.zeros(max((r.a for r in tops), default=0) + 1, np.int64)
    for r in tops:
        highest[r.a] = r.n
    sent = Sent(spark, highest)
    back = totals.groupBy("portion").agg(F.collect_list(F.struct("pair", "n")).alias("found"))

    def run(batches):
        best = sent.value
        for batch in batches:
            column = batch.column(3).combine_chunks() if isinstance(batch.column(3), pa.ChunkedArray) else batch.column(3)
            for k, (docs, units, links) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                found = column[k].values
                pair, n = (np.asarray(found.field(i)) if found is not None else np.zeros(0, np.int64) for i in range(2))
                n = n[np.argsort(pair)]
                pair = np.sort(pair)
                held, of = _from_cells(units), _from_cells(links)
                counts = _sums(of, n)
                bests = _sums(of, (n == best[pair >> 32]).astype(np.int64))
                rows = opened(docs)
                at = np.asarray(rows.column(rows.schema.get_field_index("at")))
                columns = {c: rows.column(rows.schema.get_field_index(c)) for c in ["doc_id", *DOCS, "groups_sha256"]}
                for name, weights in (("n_best", bests), ("count_sum", counts)):
                    column_of = np.zeros(len(at), np.int64)
                    column_of[at >= 0] = _sums(held, weights)[at[at >= 0]]
                    columns[name] = pa.array(column_of)
                names = [c.split(" ")[0] for c in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return table.select("portion", "docs", "units", "links").join(back, "portion", "left").select("docs", "units", "links", "found").mapInArrow(run, RESULT)
