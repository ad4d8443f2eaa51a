"""Tables with snapshots: files that never change, and numbered manifests that name them.

A write puts its files into a folder of its own and then commits a manifest by one
rename that fails if the number is taken.  A reader takes the newest manifest, so
it never sees half a write, and a writer that is lost before its rename leaves
nothing but files that no manifest names.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.sources import upserts

BUCKET = "key_bucket"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    """Numbered manifests (JSON) in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def place(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def fs(self):
        return self.place("x").getFileSystem(self.conf)

    def numbers(self) -> list[int]:
        if not self.fs().exists(self.hadoop.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs().listStatus(self.hadoop.Path(self.path))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs().open(self.place(f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The newest number and manifest; 0 and none before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def commit(self, number: int, manifest: dict) -> None:
        """Make `manifest` version `number`, at once or not at all."""
        own = self.place(f".{uuid.uuid4().hex}")
        out = self.fs().create(own, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            self.hadoop.FileContext.getFileContext(own.toUri(), self.conf).rename(own, self.place(f"{number:012d}.json"), none)
        except Exception as error:
            self.fs().delete(own, False)
            if "AlreadyExists" in str(error):
                raise Conflict(f"version {number} of {self.path} exists") from error
            raise


def nullable(kind: T.DataType) -> T.DataType:
    """A type in which everything may be null, so that later batches fit it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """The bucket of a key among `buckets` of a linear hash: one bucket more moves keys
    of one bucket only, so a table can grow bucket by bucket."""
    half = 1 << (buckets.bit_length() - 1)
    wide = F.pmod(F.xxhash64(*key), F.lit(2 * half))
    return F.when(wide < buckets, wide).otherwise(wide - half).cast("int")


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row has: its texts, and eight for each other column."""
    long = [f.name for f in schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in long), F.lit(8 * (len(schema) - len(long))).cast("long"))


def split_from(old: int, new: int) -> set[int]:
    """Buckets of `old` that lose keys when there are `new`."""
    out = set()
    for bucket in range(old, new):
        while bucket >= old:
            bucket -= 1 << (bucket.bit_length() - 1)
        out.add(bucket)
    return out


class SnapshotTable:
    """A table of rows with a key, in buckets by a linear hash of the key.

    An upsert reads the keys of the buckets that its rows fall into, rewrites the
    files that hold one of them, and adds a file to each of these buckets; all other
    files stay.  Buckets split as the table grows, so that each has about
    `bucket_rows`, and a bucket of over `most_files` files is written anew as one.
    So what a batch reads and writes follows the batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = ("id",), bucket_rows: int = 1 << 20, most_files: int = 8, bucket_bytes: int = 64 << 20) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.bucket_rows, self.most_files, self.bucket_bytes = bucket_rows, most_files, bucket_bytes
        self.versions = Versions(spark, f"{self.path}/versions")
        #: Files that the last write took away, files it made, and buckets after it.
        self.last = {"retired": 0, "made": 0, "buckets": 0}

    # -- reading --

    def _files(self, names: Sequence[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    @staticmethod
    def _schema(manifest: dict) -> T.StructType:
        return T.StructType.fromJson(manifest["schema"])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, by default the newest; none before the first write."""
        manifest = self.versions.latest()[1] if version is None else self.versions.read(version)
        return None if manifest is None else self._files([name for _, name, _ in manifest["files"]], self._schema(manifest))

    def exists(self) -> bool:
        return bool(self.versions.numbers())

    def applied(self, writer: str) -> int:
        """The highest batch of a writer that the table holds, or -1."""
        manifest = self.versions.latest()[1]
        return -1 if manifest is None else manifest["applied"].get(writer, -1)

    # -- writing --

    def _written(self, rows: DataFrame, parts: int) -> list[list]:
        """Write rows with their buckets into a new folder: [bucket, file, rows] of each file."""
        folder = f"data/{uuid.uuid4().hex}"
        # Sorted keys and Bloom filters let a reader of few keys skip row groups.
        writer = rows.repartition(parts, BUCKET).sortWithinPartitions(BUCKET, *self.key).write.partitionBy(BUCKET)
        for k in self.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/{folder}")
        own = self.spark.read.schema(rows.drop(BUCKET).schema).parquet(f"{self.path}/{folder}") if rows.columns else rows
        counts = own.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file
        out = []
        for r in counts:
            name = folder + r.f.split(folder, 1)[1]
            out.append([int(name.split(f"{BUCKET}=", 1)[1].split("/", 1)[0]), name, r.n])
        return out

    def state(self) -> dict:
        """What writers have put beside their rows."""
        manifest = self.versions.latest()[1]
        return {} if manifest is None else manifest.get("state", {})

    def _commit(self, number: int, manifest: dict, retired: set[str], made: list[list], writer: str | None, batch: int | None, state: dict | None = None) -> None:
        files = [f for f in manifest["files"] if f[1] not in retired] + made
        applied = {**manifest["applied"], **({writer: batch} if writer is not None else {})}
        self.versions.commit(number + 1, {**manifest, "files": files, "rows": sum(f[2] for f in files), "applied": applied, "state": {**manifest.get("state", {}), **(state or {})}})
        self.last = {"retired": len(retired), "made": len(made), "buckets": manifest["buckets"]}

    def _begin(self, rows: DataFrame, writer: str | None, batch: int | None) -> tuple[int, dict] | None:
        """The version to build on, or none if the batch has been applied."""
        if (writer is None) != (batch is None):
            raise ValueError("a batch has a writer and a number, or neither")
        number, manifest = self.versions.latest()
        if manifest is None:
            manifest = {"schema": nullable(rows.schema).jsonValue(), "buckets": 1, "rows": 0, "files": [], "applied": {}}
        if writer is not None and manifest["applied"].get(writer, -1) >= batch:
            return None
        return number, manifest

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Add rows as they are.  A batch of a writer that is there already, by its
        number, is not added again; numbers of a writer go up."""
        begun = self._begin(rows, writer, batch)
        if begun is None:
            return False
        number, manifest = begun
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(*self._schema(manifest).names).withColumn(BUCKET, bucket_of(self.key, manifest["buckets"]))
        self._commit(number, manifest, set(), self._written(dealt, parts), writer, batch)
        return True

    def upsert(self, rows: DataFrame, order: str, mode: str = "merge", keep_if_null: Sequence[str] | None = None, writer: str | None = None, batch: int | None = None,
               state: dict | None = None) -> bool:
        """Put a batch into the table by its key, the last by `order` of equal keys;
        mode "merge" keeps old values for nulls (of `keep_if_null`, or all columns),
        "replace" takes whole rows, "ignore" only new keys.  `state` is committed with
        the rows.  False if the batch of this writer was applied before, or is empty
        and brings no state."""
        table_rows = rows.drop(order)
        begun = self._begin(table_rows, writer, batch)
        if begun is None:
            return False
        number, manifest = begun
        schema, old_buckets = self._schema(manifest), manifest["buckets"]
        # A row for each bucket that the batch falls into.
        found = rows.groupBy(bucket_of(self.key, old_buckets)).agg(F.count(F.lit(1)), F.sum(row_bytes(table_rows.schema))).collect()
        touched = {r[0]: r[1] for r in found}
        if not touched:
            if state is not None:
                self._commit(number, manifest, set(), [], writer, batch, state)
            return state is not None
        size = max(1, sum(r[2] for r in found) // sum(touched.values()))
        most = max(1, min(self.bucket_rows, self.bucket_bytes // size))
        buckets = max(old_buckets, -(-(manifest["rows"] + sum(touched.values())) // most))
        parted = split_from(old_buckets, buckets)
        of: dict[int, list[str]] = {}
        for bucket, name, _ in manifest["files"]:
            of.setdefault(bucket, []).append(name)
        asked = [name for b in touched if b not in parted for name in of.get(b, [])]
        retired = {name for b in parted for name in of.get(b, [])}
        retired |= {name for b in touched if len(of.get(b, [])) >= self.most_files for name in of[b]}
        retired |= self._holding([n for n in asked if n not in retired], rows, schema)
        old = self._files(sorted(retired), schema)
        new = rows.select(*[c for c in rows.columns if c in schema.names], order)
        if mode == "replace":
            made = upserts.replace(old, new, self.key, order)
        elif mode == "ignore":
            made = upserts.insert_ignore(old, new, self.key, order)
        else:
            keep = [c for c in schema.names if c not in self.key] if keep_if_null is None else keep_if_null
            made = upserts.merge(old, new, self.key, order, keep)
        dealt = made.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names]).withColumn(BUCKET, bucket_of(self.key, buckets))
        files = self._written(dealt, max(1, min(len(touched) + buckets - old_buckets + len(parted), 4096)))
        self._commit(number, {**manifest, "buckets": buckets}, retired, files, writer, batch, state)
        return True

    def _holding(self, names: list[str], rows: DataFrame, schema: T.StructType) -> set[str]:
        """Files that hold a key of `rows`: their key columns alone are read."""
        if not names:
            return set()
        keys = self._files(names, T.StructType([schema[k] for k in self.key])).select(*self.key, F.col("_metadata.file_path").alias("__file")).alias("o")
        same = F.lit(True)
        for k in self.key:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        found = keys.join(rows.select(*self.key).alias("n"), same, "left_semi").select("__file").distinct().collect()  # files, at most one a key
        return {"data/" + r[0].rsplit("/data/", 1)[1] for r in found}

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the newest `keep`, and folders that none of these names;
        no writer may be at work.  How many folders went."""
        numbers = self.versions.numbers()
        named = {f[1].split("/")[1] for n in numbers[-keep:] for f in self.versions.read(n)["files"]}
        fs, gone = self.versions.fs(), 0
        for n in numbers[:-keep]:
            fs.delete(self.versions.place(f"{n:012d}.json"), False)
        data = self.versions.hadoop.Path(f"{self.path}/data")
        for status in fs.listStatus(data) if fs.exists(data) else []:
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone
