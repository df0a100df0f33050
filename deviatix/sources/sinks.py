"""Sinks: bucketed facts, frozen versions with their metadata, incremental appends."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A folder per hash bucket, not per recording; written again, only the buckets present are replaced."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def metadata(df: DataFrame, key: str, source: str) -> DataFrame:
    """One row: rows, distinct keys, rows per source, column list, and a hash that the order of rows does not change."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(source), F.lit("")).alias("k"), "n")))).alias("per_source")).withColumn("_k", F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content")).withColumn("_k", F.lit(0))
    return one.join(F.broadcast(per), "_k").drop("_k").withColumn("columns", F.lit(",".join(df.columns)))


def freeze(df: DataFrame, path: str, version: str, key: str, source: str) -> DataFrame:
    """Writes the table and its metadata under a version; refuses an existing one."""
    df.write.mode("error").parquet(f"{path}/{version}/data")
    meta = metadata(df.sparkSession.read.parquet(f"{path}/{version}/data"), key, source).withColumn("version", F.lit(version))
    meta.write.mode("error").json(f"{path}/{version}/meta")
    return meta


def append_new(df: DataFrame, spark: SparkSession, path: str, ledger: str, key: str, batch: str | None = None) -> int:
    """Appends the rows of keys that the ledger lacks, then records the keys: running again adds nothing.

    Data and ledger have a folder per batch. The ledger's is written last; ``appended`` reads only batches that it has,
    so what a crash leaves behind is not seen, and the same batch run again replaces it."""
    batch = batch or uuid.uuid4().hex
    try:
        done = spark.read.parquet(ledger).where(F.col("batch") != batch).select(key).distinct()
    except AnalysisException as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    keys = spark.read.schema(new.schema).parquet(f"{path}/batch={batch}").select(key).distinct()
    keys.write.mode("overwrite").parquet(f"{ledger}/batch={batch}")
    return spark.read.schema(keys.schema).parquet(f"{ledger}/batch={batch}").count()


def appended(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """The rows of all batches that the ledger has."""
    batches = spark.read.parquet(ledger).select(F.col("batch").cast("string").alias("batch")).distinct()
    data = spark.read.parquet(path)
    return data.withColumn("batch", F.col("batch").cast("string")).join(batches.hint("merge"), "batch", "left_semi").drop("batch")
