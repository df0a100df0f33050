"""Sources: Parquet by recording, string CSV, JSON sidecars, names, nested arrays, ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares greater than anything in Spark: every source turns it into null."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def recordings(spark: SparkSession, root: str, key: str, ids: list | DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of some recordings: a short list is pushed down to the scan, a table of ids is a semi join."""
    df = spark.read.parquet(root)
    if isinstance(ids, DataFrame):
        df = df.join(ids.select(key).distinct(), key, "left_semi")
    elif ids is not None:
        df = df.where(F.col(key).isin(ids))
    return nan_to_null(df.select(*columns) if columns else df)


def string_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Some columns of wide CSV files, all as text."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path).select(*columns)


def csv_glob(spark: SparkSession, pattern: str | list[str], columns: list[str]) -> DataFrame:
    """Files of one shape by a pattern, as one scan: ``columns`` names all their columns in order, all text."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(pattern)


def csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A few files of different shapes; same-shape files are one scan with ``csv_glob``."""
    out = None
    for p in paths:
        one = spark.read.option("header", True).csv(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def sidecars(spark: SparkSession, path: str, schema: str, required: str, key: str) -> DataFrame:
    """JSON records; malformed ones and markers without the required field go; one per key."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.where(F.col(required).isNotNull()).dropDuplicates([key])


def one_constant(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df``, which must agree on a column: reading fails where a row differs from the others."""
    one = df.agg(F.min(column).alias("_least"), F.max(column).alias("_most"), F.lit(0).alias("_k"))
    out = df.withColumn("_k", F.lit(0)).join(F.broadcast(one), "_k")
    same = F.when(F.col("_least") == F.col("_most"), F.col(column)).otherwise(F.raise_error(F.lit(f"{column} is not constant")).cast(df.schema[column].dataType))
    return out.withColumn(column, same).drop("_k", "_least", "_most")


def from_names(df: DataFrame, name: Column, pattern: str, fields: list[str]) -> DataFrame:
    """Fields of a file name by the groups of a pattern; null where it does not match."""
    return df.withColumns({f: F.nullif(F.regexp_extract(name, pattern, i + 1), F.lit("")) for i, f in enumerate(fields)})


def tidy_array(df: DataFrame, keys: list[str], nested: str, index: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(nested).alias(index, value))


def age_at(recordings: DataFrame, persons: DataFrame, key: str, start: str, birth: str) -> DataFrame:
    """age in years of 365.25 days."""
    return recordings.join(persons.select(key, birth), key).withColumn("age", (epoch(F.col(start)) - epoch(F.col(birth))) / 31557600.0)
