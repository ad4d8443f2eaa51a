"""A stored inverted index for BM25.

A row of the postings is a term in a block: the documents of one group and one day
(parts of a day, if it has many), so the blocks of all terms hold the same
documents and a window of time leaves whole blocks out.  It has the documents with
their frequencies and lengths, and the block's maximum: the highest frequency and
the least length, which bound the score of the block's documents whatever the
average length is by then.  Rows stand in folders by the hash of their term, in
order of the term, so a query reads the rows of its terms.  Lengths of documents
are a narrow table, and each group's documents and tokens of a day are added up
beside it, so the average length of a window takes a row a day and the documents
of the day that it begins in.  All of these only grow: an append adds a folder,
and counts add up when they are read.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import config
from feedloom.functions.chunks import short_batches
from feedloom.functions.text import tokens
from feedloom.sources.versions import Versions

DAY = 86_400
BLOCK = ["group", "day", "shard"]
#: Documents whose tokens are counted at once.
COUNTED = 256


def _counted(id_type: str):
    """(…, term, tf, dl) of each document's tokens, counted in place."""
    schema = f"id {id_type}, `group` string, at long, day int, shard int, dl int, term string, tf int"

    def run(batches):
        for batch in (b.slice(lo, COUNTED) for b in batches for lo in range(0, b.num_rows, COUNTED)):
            lists = batch.column(batch.num_columns - 1)
            coded = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            keys, tf = np.unique((row.astype(np.int64) << 32) | np.asarray(coded.indices), return_counts=True)
            at = pa.array(keys >> 32)
            columns = [batch.column(k).take(at) for k in range(batch.num_columns - 1)]
            terms = coded.dictionary.take(pa.array(keys & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(tf.astype(np.int32))], names=["id", "group", "at", "day", "shard", "dl", "term", "tf"])

    return run, schema


def _blocks(id_type: str):
    """Rows that are sorted by part, term and block, as a row a term and block."""
    schema = f"part int, term string, `group` string, day int, shard int, docs array<struct<id: {id_type}, at: bigint, tf: int, dl: int>>, n long, most int, least int, first_at long, last_at long"

    def starts(rows):
        change = np.zeros(rows.num_rows, bool)
        change[:1] = True
        for name in ("part", "term", *BLOCK):
            column = rows.column(name).combine_chunks()
            codes = np.asarray(column.dictionary_encode().indices if pa.types.is_string(column.type) else column)
            change[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(change)

    def made(rows, first):
        columns = {name: rows.column(name).combine_chunks() for name in rows.column_names}
        heads = pa.array(first)
        docs = pa.StructArray.from_arrays([columns[name] for name in ("id", "at", "tf", "dl")], names=["id", "at", "tf", "dl"])
        ends = np.append(first, rows.num_rows)
        tf, dl, at = (np.asarray(columns[name]) for name in ("tf", "dl", "at"))
        out = {name: columns[name].take(heads) for name in ("part", "term", *BLOCK)}
        out["docs"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), docs)
        out["n"] = pa.array(np.diff(ends))
        for name, least, values in (("most", np.maximum, tf), ("least", np.minimum, dl), ("first_at", np.minimum, at), ("last_at", np.maximum, at)):
            out[name] = pa.array(least.reduceat(values, first))
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def run(batches):
        held = None  # the rows of the last block so far
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rows = now if held is None else pa.concat_tables([held, now])
            if rows.num_rows == 0:
                continue
            first = starts(rows)
            if len(first) > 1:
                yield made(rows.slice(0, first[-1]), first[:-1])
            held = rows.slice(first[-1])
        if held is not None:
            yield made(held, np.array([0]))

    return run, schema


class TermIndex:
    """BM25 from postings: whole score tables, and the best k of each group without
    the blocks that can't have one of them."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, spread: int = 4, block_docs: int = 1024, k1: float = config.K1, b: float = config.B) -> None:
        self.spark, self.path, self.parts, self.spread, self.block_docs, self.k1, self.b = spark, path.rstrip("/"), parts, spread, block_docs, k1, b
        self.versions = Versions(spark, f"{self.path}/versions")
        self._kept: list[DataFrame] = []

    def release(self) -> None:
        """Free the block maxima that top() keeps in memory, or on disk, for its result."""
        while self._kept:
            self._kept.pop().unpersist()

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def append(self, rows: DataFrame, text: Column, group: Column | None = None, at: Column | None = None, key: str = "id") -> None:
        """Add documents; their ids are new to the index.  The batch is read twice, to
        see how many documents each group and day has (a row each), and to count."""
        group = F.lit("") if group is None else F.coalesce(group, F.lit(""))
        at = F.lit(0) if at is None else at
        days = F.floor(at.cast("long") / DAY).cast("int")
        sizes = rows.groupBy(group.alias("group"), days.alias("day")).agg(F.ceil(F.count(F.lit(1)) / self.block_docs).alias("shards"))
        docs = rows.select(F.col(key).alias("id"), group.alias("group"), at.cast("long").alias("at"), days.alias("day"), tokens(text).alias("t"))
        docs = docs.join(F.broadcast(sizes), ["group", "day"])
        docs = docs.select("id", "group", "at", "day", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), F.size("t").alias("dl"), "t")
        short_batches(10_000)  # a row holds the tokens of a whole text, and later a posting
        run, schema = _counted(rows.schema[key].dataType.simpleString())
        counted = docs.mapInArrow(run, schema).withColumn("part", self._part(F.col("term")))
        # A common term's blocks are spread over several tasks; a block of a term is in one.
        counted = counted.withColumn("salt", F.pmod(F.xxhash64(*BLOCK), F.lit(self.spread)).cast("int"))
        dealt = counted.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "part", "salt")
        packed, columns = _blocks(rows.schema[key].dataType.simpleString())
        postings = dealt.sortWithinPartitions("part", "term", *BLOCK).select("part", "term", *BLOCK, "id", "at", "tf", "dl").mapInArrow(packed, columns)
        folder = uuid.uuid4().hex
        postings.sortWithinPartitions("part", "term", *BLOCK).write.partitionBy("part").option("parquet.block.size", 4 << 20).parquet(f"{self.path}/{folder}/postings")
        lengths = docs.select("id", "group", "at", "dl")
        lengths.sortWithinPartitions("at").write.parquet(f"{self.path}/{folder}/documents")
        read = self.spark.read.schema(lengths.schema).parquet(f"{self.path}/{folder}/documents")
        daily = read.groupBy("group", F.floor(F.col("at") / DAY).cast("int").alias("day")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("dl").cast("long")).alias("tokens"))
        daily.write.parquet(f"{self.path}/{folder}/days")
        number, manifest = self.versions.latest()
        folders = manifest["folders"] if manifest else []
        fields = {"documents": lengths.schema.jsonValue(), "postings": postings.schema.jsonValue(), "days": daily.schema.jsonValue()}
        self.versions.commit(number + 1, {"folders": [*folders, folder], **fields})

    def _read(self, name: str) -> DataFrame:
        manifest = self.versions.latest()[1]
        if manifest is None:
            raise ValueError("the index has no documents yet")
        reader = self.spark.read.schema(T.StructType.fromJson(manifest[name]))
        parts = [reader.option("basePath", f"{self.path}/{f}/{name}").parquet(f"{self.path}/{f}/{name}") for f in manifest["folders"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def documents(self, since: int | None = None) -> DataFrame:
        """(id, group, at, dl) of the documents from `since` on."""
        rows = self._read("documents")
        return rows if since is None else rows.where(F.col("at") >= since)

    def stats(self, since: int | None = None) -> DataFrame:
        """(group, all_docs, avgdl) of the documents from `since` on: sums of whole days,
        and the documents of the day that holds `since`."""
        days = self._read("days")
        if since is not None:
            edge = since // DAY + 1
            own = self.documents(since).where(F.col("at") < edge * DAY)
            days = days.where(F.col("day") >= edge).select("group", "docs", "tokens").unionByName(own.select("group", F.lit(1).cast("long").alias("docs"), F.col("dl").cast("long").alias("tokens")))
        return days.groupBy("group").agg(F.sum("docs").alias("all_docs"), (F.sum("tokens") / F.sum("docs")).alias("avgdl"))

    def postings(self, terms: Sequence[str], since: int | None = None) -> DataFrame:
        """The rows of some terms; only their folders and row groups are read."""
        manifest = self.versions.latest()[1]
        if manifest is None:
            raise ValueError("the index has no documents yet")
        schema = T.StructType.fromJson(manifest["postings"])
        # The hash of a term as Spark has it, so that only the folders of the terms are listed.
        parts = sorted({xxhash.xxh64_intdigest(t.encode(), 42) for t in terms})
        parts = sorted({(h - (1 << 64) if h >> 63 else h) % self.parts for h in parts})
        rows = self.spark.createDataFrame([], schema)
        for folder in manifest["folders"]:
            base = f"{self.path}/{folder}/postings"
            own = [f"{base}/part={p}" for p in parts if self.versions.fs().exists(self.versions.hadoop.Path(f"{base}/part={p}"))]
            if own:
                rows = rows.unionByName(self.spark.read.schema(schema).option("basePath", base).parquet(*own).where(F.col("term").isin(list(dict.fromkeys(terms)))))
        return rows if since is None else rows.where(F.col("last_at") >= since)

    # -- scores --

    def _asked(self, terms: Sequence[str] | dict[str, Sequence[str]], groups: Sequence[str] | None) -> tuple[list[str], DataFrame]:
        """Different terms, and (group, term, times): a query's terms for each group."""
        lists = terms if isinstance(terms, dict) else dict.fromkeys([""] if groups is None else groups, list(terms))
        rows = [(g, t, list(each).count(t)) for g, each in lists.items() for t in dict.fromkeys(each)]
        return list(dict.fromkeys(t for _, t, _ in rows)), self.spark.createDataFrame(rows, "`group` string, term string, times int")

    def _weights(self, asked: DataFrame, df: DataFrame, since: int | None) -> DataFrame:
        """(group, term, weight, avgdl): what a term counts in a group; a row each."""
        rows = asked.join(self.stats(since), "group").join(df, ["group", "term"])
        idf = F.ln((F.col("all_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        return rows.select("group", "term", (idf * F.col("times")).alias("weight"), "avgdl")

    def _value(self, tf: Column, dl: Column) -> Column:
        ratio = F.coalesce(F.try_divide(dl, F.col("avgdl")), F.lit(0.0))
        return F.col("weight") * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * ratio))

    @staticmethod
    def _exploded(postings: DataFrame, since: int | None) -> DataFrame:
        rows = postings.select("group", "term", F.explode("docs").alias("d")).select("group", "term", "d.id", "d.at", "d.tf", "d.dl")
        return rows if since is None else rows.where(F.col("at") >= since)

    def scores(self, terms: Sequence[str] | dict[str, Sequence[str]], since: int | None = None) -> DataFrame:
        """(id, group, bm25_raw, bm25) of all documents from `since` on, against those of
        their group; texts are not read.  Groups without terms score 0."""
        different, asked = self._asked(terms, None)
        docs = self.documents(since)
        hits = self._exploded(self.postings(different, since), since)
        df = hits.groupBy("group", "term").agg(F.count(F.lit(1)).alias("df"))
        weights = self._weights(asked, df, since)
        raw = hits.join(F.broadcast(weights), ["group", "term"]).groupBy("id").agg(F.sum(self._value(F.col("tf"), F.col("dl"))).alias("raw"))  # weights: a row a group and term
        rows = docs.join(raw, "id", "left").select("id", "group", F.coalesce("raw", F.lit(0.0)).alias("bm25_raw"))
        most = rows.groupBy("group").agg(F.greatest(F.max("bm25_raw"), F.lit(1.0)).alias("most"))
        rows = rows.join(F.broadcast(most), "group")  # a row a group
        return rows.select("id", "group", "bm25_raw", F.least(F.col("bm25_raw") / F.col("most"), F.lit(1.0)).alias("bm25"))

    def bounds(self, terms: Sequence[str] | dict[str, Sequence[str]], since: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(group, day, shard, bound, n): the highest score that a document of each block
        can have, and at least how many score; and the weights.  Of blocks that lie
        wholly in the window no documents are read."""
        different, asked = self._asked(terms, None)
        rows = self.postings(different, since)
        heads = rows.select(*BLOCK, "term", "n", "most", "least", "first_at")
        if since is not None:
            cut = rows.where(F.col("first_at") < since).select(*BLOCK, "term", F.size(F.filter("docs", lambda d: d["at"] >= since)).cast("long").alias("n"), "most", "least", "first_at")
            heads = heads.where(F.col("first_at") >= since).unionByName(cut)
        heads = heads.persist()  # a row a term and block, read for the frequencies and for the bounds
        self._kept.append(heads)
        df = heads.groupBy("group", "term").agg(F.sum("n").alias("df"))
        weights = self._weights(asked, df, since)
        # A row a group and term: worked out once, for the bounds and for the scores.
        weights = self.spark.createDataFrame(weights.collect(), weights.schema)
        bound = heads.join(F.broadcast(weights), ["group", "term"]).groupBy(*BLOCK).agg(F.sum(self._value(F.col("most"), F.col("least"))).alias("bound"), F.max("n").alias("n"))
        return bound, weights

    def top(self, terms: Sequence[str] | dict[str, Sequence[str]], k: int, since: int | None = None) -> DataFrame:
        """(group, id, bm25_raw): the best k of each group with a positive score.

        Blocks of the highest bounds that have k documents give the k-th best score so
        far; then only blocks whose bound reaches it are read.  release() frees what the
        result keeps cached, once it has been read."""
        different, _ = self._asked(terms, None)
        bound, weights = self.bounds(terms, since)
        order = Window.partitionBy("group").orderBy(F.desc("bound"), "day", "shard").rowsBetween(Window.unboundedPreceding, -1)
        # Of each group the first blocks, at most k (each has a document).
        first = bound.where("n > 0").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k)
        near = self._scored(different, first, weights, since)
        place = Window.partitionBy("group").orderBy(F.desc("bm25_raw"))
        least = near.withColumn("k", F.row_number().over(place)).where(F.col("k") == k).select("group", "bm25_raw").collect()  # a row a group
        reached = F.lit(0.0)
        for r in least:
            reached = F.when(F.col("group") == r[0], F.lit(r[1])).otherwise(reached)
        chosen = bound.where(F.col("bound") >= reached - 1e-9)
        days = [r[0] for r in chosen.select("day").distinct().collect()]  # days of the index, at most
        found = self._scored(different, chosen, weights, since, days)
        best = Window.partitionBy("group").orderBy(F.round("bm25_raw", 9).desc(), "id")
        return found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select("group", "id", "bm25_raw")

    def _scored(self, terms: Sequence[str], blocks: DataFrame, weights: DataFrame, since: int | None, days: Sequence[int] | None = None) -> DataFrame:
        """Scores of the documents of some blocks, which all lie on `days`."""
        rows = self.postings(terms, since)
        rows = rows if days is None else rows.where(F.col("day").isin(list(days)) if days else F.lit(False))
        rows = rows.join(blocks.select(*BLOCK), BLOCK, "left_semi")
        hits = self._exploded(rows, since).join(F.broadcast(weights), ["group", "term"])
        return hits.groupBy("group", "id").agg(F.sum(self._value(F.col("tf"), F.col("dl"))).alias("bm25_raw"))
