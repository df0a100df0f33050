"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as segments: eeg_id, segment, stage, value, y (log), age, artifact."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("eeg_id"), n.cast("long").alias("segment"), F.col("event_type").alias("stage"), "value", F.log(F.col("value") + 1e-12).alias("y"), (F.col("user_id") % 90 + 1).cast("double").alias("age"), (F.col("value") > 150).alias("artifact"))


#: The same in SQL.
SEG = """seg AS (SELECT user_id AS eeg_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS segment, event_type AS stage,
  value, ln(value + 1e-12) AS y, CAST(user_id % 90 + 1 AS DOUBLE) AS age, value > 150 AS artifact FROM events)"""


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (recording, channel) band powers."""
    li = table(spark, sf_dir, "lineitem")
    p = {"delta": F.col("l_quantity"), "theta": F.col("l_extendedprice") / 1000, "alpha": F.col("l_discount") * 100, "beta": F.col("l_tax") * 100, "gamma": F.col("l_linenumber").cast("double")}
    li = li.select(F.col("l_orderkey").alias("eeg_id"), F.col("l_linenumber").cast("long").alias("channel"), *[c.alias(k) for k, c in p.items()], F.col("l_returnflag").alias("stage"))
    return li.withColumn("total", sum((F.col(k) for k in list(p)[1:]), F.col("delta")))


POW = """pw AS (SELECT *, delta + theta + alpha + beta + gamma AS total FROM (SELECT l_orderkey AS eeg_id, CAST(l_linenumber AS BIGINT) AS channel,
  l_quantity AS delta, l_extendedprice / 1000 AS theta, l_discount * 100 AS alpha, l_tax * 100 AS beta, CAST(l_linenumber AS DOUBLE) AS gamma, l_returnflag AS stage FROM lineitem))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, with -0 as 0: for comparing results of two engines."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
