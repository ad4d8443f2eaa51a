"""Session helpers shared by the operators: shared tables, batch sizes, columns."""
from __future__ import annotations

import ctypes
import pickle
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; texts are long, so batches are short.
BATCH_ROWS = 1024


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary folder where that is unset and all run on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/feedloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that stored() wrote in this application, once no result of
    an operator is to be read any more."""
    _delete(spark, _own_folder(spark))


def stored(df: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, which cuts
    its lineage and survives lost executors.  Tables whose rows hold megabytes
    ask for small row groups of about `block_bytes`."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._feedloom_path = path
    return out


def stored_by(df: DataFrame, column: str, parts: int, block_bytes: int | None = None) -> DataFrame:
    """As stored(), with rows dealt into `parts` buckets by `column`, so that what is
    joined by that column comes to the table's rows, which stay where they are."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    path = f"{_own_folder(spark)}/{name}"
    writer = df.write.format("parquet").bucketBy(parts, column).option("path", path)
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).saveAsTable(f"feedloom_{name}")
    out = spark.table(f"feedloom_{name}")
    out._feedloom_path, out._feedloom_table = path, f"feedloom_{name}"
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table that stored() or stored_by() wrote, once nothing reads it any more."""
    if hasattr(df, "_feedloom_table"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._feedloom_table}")
    path = getattr(df, "_feedloom_path", None)
    if path:
        _delete(df.sparkSession, path)


class Sent:
    """A value that the driver broadcasts; its class need not be installed on executors."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.data.value)


def give_back() -> None:
    """At the start of a task: what earlier tasks of this Python worker kept (bpe's
    encoder) or freed goes back to the system; workers live on, and allocators
    keep what was freed beside what the executor's JVM takes."""
    sys.modules.pop("_feedloom_encoders", None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id as text, mod `modulus`, equals `remainder`; a null id is not held out."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns) -> str:
    """`name`, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
