"""Shared helpers: small Arrow batches, written intermediate tables, unique document ids."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.shared import shared_folder
from gleaner.shipping import ship

#: Rows and bytes of an Arrow batch, so that a worker holds a few MB of texts at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
_written: list[tuple[SparkSession, str]] = []


def start(spark: SparkSession) -> None:
    """What every operator with Python code needs: the package on the executors, and small batches
    unless the session has its own setting."""
    ship(spark)
    for key, usual, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) in (None, usual):
            spark.conf.set(name, str(ours))


def _tidy() -> None:
    """Gives a worker's freed memory back, as it may be kept for a later task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInArrow(run, schema), tidying up after each task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _tidy()

    start(rows.sparkSession)
    return rows.mapInArrow(tidied, schema)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
            pass


atexit.register(_delete_all)


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts the lineage and survives lost executors. ``drop`` frees a table that
    nothing reads any more; the rest go when the driver ends, because results are read lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        start(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _written.append((spark, self.root))

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_bucketed(self, df: DataFrame, column: str, name: str = "t") -> DataFrame:
        """As ``write``, dealt to buckets by a column, so that joins and groups by it need no shuffle of these rows."""
        self.n += 1
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}-{self.n}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(parts(self.spark), column).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._scratch_path)


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(docs with the column _uid; whether _uid differs from doc_id).

    _uid is doc_id where every doc_id is given and unique. Otherwise rows are numbered in the order
    of doc_id (nulls first), then text; rows that repeat a doc_id then count as documents of their own.
    """
    odd = docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return docs.withColumn("_uid", F.col("doc_id").cast("long")), False
    order = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return scratch.write(order.withColumn("_uid", F.monotonically_increasing_id()), "numbered"), True


def unique_ids(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(rows of doc_id, uid, text (null: empty); whether uid differs from doc_id), as by ``numbered``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, renamed = numbered(base, scratch)
    return rows.select("doc_id", F.col("_uid").alias("uid"), "text"), renamed
