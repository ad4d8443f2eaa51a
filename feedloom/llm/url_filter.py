"""URL rules in a sorted digest array that executors map into memory.

The array file has the 64-bit xxhash keys of all rule strings in ascending
order, then the rule strings and their verdicts.  The driver writes it to the shared
folder, Spark copies it to every executor, and each Python worker maps its machine's copy,
so the array is shared between workers and paged in as needed.  A batch of
urls probes the keys of all (host suffix, path prefix) strings that could be
rules in one binary search; a found key counts only if the stored string is
equal.
"""
from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import shared_dir, short_batches

MAGIC = b"urldigest1"
LOWER = {k: k + 32 for k in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): what follows the first "://" up to one of "/?#", with A-Z in
    lower case, and from there up to one of "?#".  Both are empty without "://"."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        if cut >= 0:
            rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


class DigestArray:
    """Rules by host and path prefix in a mapped file."""

    def __init__(self, path: str) -> None:
        head = struct.calcsize("<10sQQ")
        with open(path, "rb") as f:
            magic, n, size = struct.unpack("<10sQQ", f.read(head))
        if magic != MAGIC:
            raise ValueError("not a digest array")
        self.keys = np.memmap(path, np.uint64, "r", head, (n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, np.uint64, "r", head + 8 * n, (n + 1,))
        self.verdicts = np.memmap(path, np.uint8, "r", head + 16 * n + 8, (n,)) if n else np.zeros(0, np.uint8)
        self.strings = np.memmap(path, np.uint8, "r", head + 17 * n + 8, (size,)) if size else b""
        self.n = n

    @staticmethod
    def pack(rules: list[tuple[str, str, str]]) -> bytes:
        """The file's bytes for rules (verdict, host, path); equal (host, path) may occur once."""
        made = sorted((xxhash.xxh64_intdigest(text), text, verdict == "block") for verdict, text in ((v, (h + p).encode()) for v, h, p in rules))
        if len({text for _, text, _ in made}) != len(made):
            raise ValueError("a rule occurs twice")
        ends = np.cumsum([0, *(len(text) for _, text, _ in made)]).astype("<u8")
        keys = np.array([key for key, _, _ in made], "<u8").tobytes()
        head = struct.pack("<10sQQ", MAGIC, len(made), int(ends[-1]))
        return head + keys + ends.tobytes() + bytes(block for _, _, block in made) + b"".join(text for _, text, _ in made)

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The index of each string, or -1."""
        out = np.full(len(probes), -1, np.int64)
        if not self.n or not probes:
            return out
        want = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, want)
        near = np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == want))
        for k in near.tolist():  # equal digests are few; the stored string decides
            i = int(at[k])
            while i < self.n and self.keys[i] == want[k]:
                if bytes(self.strings[int(self.ends[i]) : int(self.ends[i + 1])]) == probes[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def string(self, i: int) -> str:
        return bytes(self.strings[int(self.ends[i]) : int(self.ends[i + 1])]).decode()


def rule_sizes(rules: list[tuple[str, str, str]]) -> list[tuple[int, list[int]]]:
    """Lengths of the rules' hosts, and for each the lengths of the paths after such hosts, all the longest first."""
    found: dict[int, set[int]] = {}
    for _, host, path in rules:
        found.setdefault(len(host), set()).add(len(path))
    return [(n, sorted(found[n], reverse=True)) for n in sorted(found, reverse=True)]


def probes_of(host: str, path: str, sizes: list[tuple[int, list[int]]]) -> list[bytes]:
    """Strings of all rules that could fit, the longest first: only suffixes and
    prefixes of a rule's length are made, so a long url costs no more than a short one."""
    out = []
    for n, paths in sizes:
        at = len(host) - n
        if at == 0 or (at > 0 and host[at - 1] == "."):
            tail = host[at:]
            out += [tail + path[:m] for m in paths if m <= len(path)]
    return [x.encode() for x in sorted(out, key=len, reverse=True)]


def _shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to the shared folder, unless it is there, and return its path."""
    path = f"{shared_dir(spark)}/feedloom-files/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        out = fs.create(place, True)
        out.write(bytearray(data))
        out.close()
    return path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`.

    A rule (verdict, host, path) fits its host and all subdomains if the url's
    path starts with the rule's; the longest rule wins, of equally long ones that with
    the longer host.  Without a fitting rule,
    `rule` is null and the verdict is `default`.  Null urls and urls without
    "://" have empty host and path and are judged like any other; so are very long
    urls; repeated rows stay rows; an empty table gives no rows; other columns
    are not read.
    """
    spark = pages.sparkSession
    short_batches(spark)
    rules = [(v, h.translate(LOWER), p) for v, h, p in rules]
    if any(v not in ("allow", "block") or (p and p[0] != "/") for v, _, p in rules):
        raise ValueError("a rule is (allow or block, host, path from its slash)")
    packed = DigestArray.pack(rules)
    name = f"rules-{hashlib.sha256(packed).hexdigest()[:24]}.bin"
    spark.sparkContext.addFile(_shared_file(spark, name, packed))  # copied to every executor
    sizes = rule_sizes(rules)

    def run(batches):
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            probes = [probes_of(h, p, sizes) for h, p in parts]
            found = array.find([x for xs in probes for x in xs])
            rule, verdict, at = [], [], 0
            for xs in probes:
                hits = found[at : at + len(xs)]
                at += len(xs)
                hit = int(hits[np.argmax(hits >= 0)]) if (hits >= 0).any() else -1
                rule.append(array.string(hit) if hit >= 0 else None)
                verdict.append(default if hit < 0 else "block" if array.verdicts[hit] else "allow")
            columns = [batch.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
