"""A trigram index that keeps substring searches from reading texts that can't match.

Documents are stored in blocks of a few dozen rows, some blocks to a shelf (a folder).
The index has a row for each trigram of bytes in a block, so a common trigram is a row
a block, never a row a document.  A text can hold a term only if its block has all
the term's trigrams: what is asked for is looked up first, and only shelves and row
groups with such blocks are read; the caller's own predicate then decides.  Appends
add folders; nothing is written again.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.sources.versions import Versions, nullable


def grams(text: bytes) -> np.ndarray:
    """Different trigrams of bytes, as numbers."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


class TextIndex:
    """Documents in blocks, found by parts of their texts in lower case."""

    def __init__(self, spark: SparkSession, path: str, block_docs: int = 64, shelf_blocks: int = 16, parts: int = 32) -> None:
        self.spark, self.path, self.block_docs, self.shelf_blocks, self.parts = spark, path.rstrip("/"), block_docs, shelf_blocks, parts
        self.versions = Versions(spark, f"{self.path}/versions")

    def append(self, rows: DataFrame, text: Column) -> None:
        """Add rows; `text` is all that is searched of a row."""
        folder, docs_of, shelf_of = uuid.uuid4().hex, self.block_docs, self.shelf_blocks
        number, manifest = self.versions.latest()
        stored = T.StructType([*nullable(rows.schema), T.StructField("block", T.LongType()), T.StructField("shelf", T.LongType())])

        def dealt(batches):
            task, n = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                block = task + (n + np.arange(batch.num_rows)) // docs_of
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(block // shelf_of)], names=[*batch.schema.names, "block", "shelf"])

        # Blocks follow the tasks that wrote them, so they are read back before they are indexed.
        rows.mapInArrow(dealt, stored).write.partitionBy("shelf").option("parquet.block.size", 1 << 20).parquet(f"{self.path}/{folder}/docs")

        def listed(batches):
            now, seen, out = None, [], []

            def row(block, found):
                g = np.unique(np.concatenate(found))
                return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), block))], names=["gram", "block"])

            for batch in batches:
                for block, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if block != now and seen:
                        out.append(row(now, seen))
                        seen = []
                    now = block
                    seen.append(grams((t or "").encode()))
                    if len(seen) > 256:
                        seen = [np.unique(np.concatenate(seen))]
                yield from out
                out = []
            if seen:
                yield row(now, seen)

        written = self.spark.read.schema(stored).parquet(f"{self.path}/{folder}/docs")
        found = written.select("block", text.alias("t")).mapInArrow(listed, "gram int, block long").distinct()
        spread = F.pmod("gram", F.lit(self.parts)).alias("part")
        found.select("gram", "block", spread).repartition(self.parts, "part").sortWithinPartitions("part", "gram", "block").write.partitionBy("part").parquet(f"{self.path}/{folder}/grams")
        folders = manifest["folders"] if manifest else []
        self.versions.commit(number + 1, {"folders": [*folders, folder], "schema": stored.jsonValue()})

    def blocks(self, terms: Sequence[str]) -> dict[str, list[int]] | None:
        """Blocks by folder that have all trigrams of one of the terms; none if a term is
        shorter than a trigram, as then every block can match."""
        needed = {t: grams(t.lower().encode()).tolist() for t in terms if t}
        if not needed or not all(needed.values()):
            return None
        every = sorted({g for own in needed.values() for g in own})
        manifest = self.versions.latest()[1]
        out = {}
        for folder in manifest["folders"]:
            rows = self.spark.read.schema("gram int, block long, part int").parquet(f"{self.path}/{folder}/grams")
            rows = rows.where(F.col("part").isin(sorted({g % self.parts for g in every})) & F.col("gram").isin(every))
            have = [F.count_if(F.col("gram").isin(own)) == len(own) for own in needed.values()]
            hit = have[0]
            for h in have[1:]:
                hit = hit | h
            out[folder] = sorted(r[0] for r in rows.groupBy("block").agg(hit.alias("hit")).where("hit").select("block").collect())  # numbers of blocks
        return out

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """The rows of all blocks that can hold one of the terms."""
        manifest = self.versions.latest()[1]
        if manifest is None:
            raise ValueError("the index has no documents yet")
        found, schema = self.blocks(terms), T.StructType.fromJson(manifest["schema"])
        out = self.spark.createDataFrame([], schema)
        for folder in manifest["folders"]:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/docs")
            if found is not None:
                if not found[folder]:
                    continue
                rows = rows.where(F.col("shelf").isin(sorted({b // self.shelf_blocks for b in found[folder]})))
                wanted = self.spark.createDataFrame([(b,) for b in found[folder]], "block long")
                rows = rows.where(F.col("block").between(found[folder][0], found[folder][-1])).join(F.broadcast(wanted), "block", "left_semi")
            out = out.unionByName(rows)
        return out.drop("block", "shelf")
