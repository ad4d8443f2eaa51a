"""An inverted file of vectors: lists around centroids, exact scores in the lists that are probed."""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.sources.versions import Versions

#: Vectors that centroids are fitted on, at most; rows of a list that one task compares.
SAMPLE, LIST_ROWS = 20_000, 200_000
#: Share of the nearest in the sample that the lists probed by default have.
RECALL = 0.96


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their norms; zero vectors stay."""
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Directions that a sample of unit vectors gathers around (k-means by cosine)."""
    rng = np.random.default_rng(seed)
    centers = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        own = np.concatenate([(block @ centers.T).argmax(axis=1) for block in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=len(centers)) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centers = units(sums)
    return centers


def needed(sample: np.ndarray, centers: np.ndarray, k: int = 10, queries: int = 300, recall: float = RECALL) -> int:
    """How many lists have to be probed for the share `recall` of the `k` nearest of some
    vectors of the sample, itself left out, among the sample.  Vectors without
    structure need most lists, well gathered ones a few."""
    if len(sample) < 2:
        return len(centers)
    own, ranks = (sample @ centers.T).argmax(axis=1), []
    for q in range(min(queries, len(sample))):
        score = sample @ sample[q]
        score[q] = -np.inf
        near = np.argpartition(-score, min(k, len(score) - 1))[:k]
        place = np.empty(len(centers), np.int64)
        place[np.argsort(-(centers @ sample[q]), kind="stable")] = np.arange(len(centers))
        ranks.append(place[own[near]])
    return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of `size` numbers as a matrix, and the rows that have one."""
    lists = column.to_numpy(zero_copy_only=False)
    good = np.array([v is not None and len(v) == size for v in lists], bool)
    return (np.stack([np.asarray(v, np.float64) for v in lists[good]]) if good.any() else np.zeros((0, size))), np.flatnonzero(good)


class VectorIndex:
    """All vectors of a table by the list of their nearest centroid.

    Centroids are fitted on at most `SAMPLE` vectors, those with the least hashes of
    their ids; every vector with as many numbers as these is in a list.  A search
    probes the lists nearest to a query and compares all their vectors exactly, so
    only the recall depends on the lists, never a score.  How many it probes is
    measured on the sample when the index is built: as many as have `RECALL` of
    the nearest, all of them if need be.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def build(self, vectors: DataFrame, key: str = "item_id", column: str = "embedding", lists: int | None = None) -> None:
        rows = vectors.select(F.col(key).alias("item_id"), F.col(column).cast("array<float>").alias("embedding")).where("embedding is not null")
        sample = rows.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).toArrow().column("embedding").combine_chunks()
        sizes = [len(v) for v in sample.to_pylist()]
        size = max(set(sizes), key=sizes.count) if sizes else 0
        matrix, _ = _matrix(sample, size)
        if lists is None:
            lists = int(min(4096, max(1, round(np.sqrt(rows.count())))))
        centers = centroids(units(matrix), lists) if len(matrix) else np.zeros((1, size))
        sent = self.spark.sparkContext.broadcast(centers)  # at most 4,096 lists

        def assigned(batches):
            for batch in batches:
                matrix, at = _matrix(batch.column(1), size)
                own = (units(matrix) @ sent.value.T).argmax(axis=1) if len(at) else np.zeros(0, np.int64)
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own.astype(np.int32))], names=["item_id", "embedding", "list"])

        schema = f"item_id {rows.schema['item_id'].dataType.simpleString()}, embedding array<float>, list int"
        folder = uuid.uuid4().hex
        # A list of many rows is in several files, so that several tasks write and compare it.
        salt = F.pmod(F.xxhash64("item_id"), F.lit(8))
        dealt = rows.mapInArrow(assigned, schema).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "list", salt)
        dealt.write.partitionBy("list").parquet(f"{self.path}/{folder}")
        counts = {r[0]: r[1] for r in self._read(folder, schema).groupBy("list").agg(F.count(F.lit(1))).collect()}  # a row a list
        number, _ = self.versions.latest()
        self.versions.commit(number + 1, {"folder": folder, "schema": schema, "size": size, "centers": centers.tolist(), "probes": needed(units(matrix), centers), "counts": {str(k): n for k, n in counts.items()}})

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, key: str = "query_id", column: str = "q") -> DataFrame:
        """(query_id, item_id, cosine): the k best of the probed lists for each query; of
        equal cosines (9 decimals) the smaller ids.  Queries without a vector of the
        right size find nothing."""
        _, kept = self.versions.latest()
        if kept is None:
            raise ValueError("the index has not been built")
        size, centers = kept["size"], np.array(kept["centers"])
        parts = {int(c): -(-n // LIST_ROWS) for c, n in kept["counts"].items()}
        probes = min(kept["probes"] if probes is None else probes, len(centers))
        sent = self.spark.sparkContext.broadcast((centers, parts))
        ids = queries.schema[key].dataType.simpleString()
        item = self._read(kept["folder"], kept["schema"])
        item_type = item.schema["item_id"].dataType.simpleString()

        def probed(batches):
            centers, parts = sent.value
            for batch in batches:
                matrix, at = _matrix(batch.column(1), size)
                near = np.argsort(-(units(matrix) @ centers.T), axis=1, kind="stable")[:, :probes]
                rows = [(r, c, p) for r, own in zip(at.tolist(), near.tolist()) for c in own for p in range(parts.get(c, 0))]
                take = pa.array([r for r, _, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c, _ in rows], pa.int32()), pa.array([p for _, _, p in rows], pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "part", "query_id", "q"])

        asked = queries.select(F.col(key).alias("query_id"), F.col(column).cast("array<float>").alias("q")).mapInArrow(probed, f"list int, part int, query_id {ids}, q array<float>")
        how_many = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.create_map().cast("map<int,int>")
        item = item.withColumn("part", F.pmod(F.xxhash64("item_id"), F.element_at(how_many, F.col("list"))).cast("int"))

        def compared(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if len(q) == 0 or len(v) == 0:
                return pd.DataFrame({"query_id": [], "item_id": [], "cosine": []})
            vectors, out = units(np.stack(v["embedding"]).astype(np.float64)), []
            names = v["item_id"].to_numpy()
            for a in range(0, len(q), 256):
                some = q.iloc[a : a + 256]
                score = units(np.stack(some["q"]).astype(np.float64)) @ vectors.T
                for name, row in zip(some["query_id"], score):
                    row = np.round(row, 12)
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    at = np.flatnonzero(row >= least - 1e-9)  # ties are settled below
                    out.append(pd.DataFrame({"query_id": name, "item_id": names[at], "cosine": row[at]}))
            return pd.concat(out)

        met = asked.groupBy("list", "part").cogroup(item.groupBy("list", "part")).applyInPandas(compared, f"query_id {ids}, item_id {item_type}, cosine double")
        best = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "item_id")
        return met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")
