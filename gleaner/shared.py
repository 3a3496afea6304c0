"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_cut: list[tuple[SparkSession, str]] = []


def _tidy() -> None:
    for spark, path in _cut:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone when the interpreter ends
            pass


atexit.register(_tidy)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that lost executors don't make their plan run
    again. The table is read anew: unlike a checkpoint it has its own size, not the estimate of the plan
    that made it, which grows without bound in a loop. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cut.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
