"""Tables written in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests), a temporary folder."""
    sc = spark.sparkContext
    return (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Folders of ``stored`` that this driver has written and not discarded.
_WRITTEN: list[str] = []


def discard_stored(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` has written for this driver so far and returns how many. To be called when no result that
    reads them is needed any more: a long-lived driver would else fill the shared folder."""
    n = len(_WRITTEN)
    while _WRITTEN:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back: its lineage is cut, and each use sees the same rows in the same partitions."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
