"""Arrays and record batches inside single rows: packed numbers, portions of a table."""
from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from feedloom.llm.text import U64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: sorted 64-bit numbers by their differences, others as they
    are, byte planes apart, compressed."""
    out = []
    for x in arrays:
        if x.dtype == np.uint64:
            x = np.diff(x, prepend=U64(0))
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""
        small = pa.Codec("zstd", compression_level=3).compress(planes, asbytes=True)
        out += [struct.pack("<QQc", len(small), len(x), x.dtype.char.encode()), small]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
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


def sealed(batch: pa.RecordBatch) -> bytes:
    """A record batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def portions(batches, limit: int):
    """Yield (portion, ids, texts): the rows of a task's batches (id, text) in portions
    of about `limit` bytes of text; a longer text is a portion of its own.  The number
    of a portion is that of the task and its place there, so a table of portions must
    be written before it is used."""
    task, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def whole():
        return (task << 32) | k, pa.concat_arrays(ids), pa.concat_arrays(texts)

    for batch in batches:
        column = batch.column(1).cast(pa.large_string())
        ends, lo = np.cumsum(pc.binary_length(column.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)), 0
        while lo < len(column):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + (not size), int(np.searchsorted(ends, done + limit - size, "right")))
            if hi > lo:
                ids.append(batch.column(0).slice(lo, hi - lo))
                texts.append(column.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - done
            if hi < len(column) or size >= limit:
                yield whole()
                k, ids, texts, size = k + 1, [], [], 0
            lo = hi
    if ids:
        yield whole()


def whole(batches, columns: int) -> list[np.ndarray]:
    """All rows of a task as one array for each column."""
    parts: list[list[np.ndarray]] = [[] for _ in range(columns)]
    for batch in batches:
        for part, column in zip(parts, batch.columns):
            part.append(np.asarray(column))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def sliced(columns: dict[str, np.ndarray], rows: int = 1 << 17):
    """Columns as record batches of bounded size."""
    n = len(next(iter(columns.values())))
    for a in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + rows]) for c in columns.values()], names=list(columns))
