"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the "alphanumeric" contracts (after A-Z are lower-cased): digits, a-z and everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same with A-Z still in place.
ALNUM_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of the "whitespace" contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: str.translate table that lower-cases A-Z alone.
LOWER_AZ = {ord(c): c.lower() for c in UPPER}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: as a lambda's variable it cannot be copied into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded_bytes(text: Column) -> Column:
    """A stand-in of a string for hashing and comparing, in which A-Z and a-z are equal and nothing else is.

    The UTF-8 bytes are read as Latin-1 and lower-cased by the fast built-in. That also maps the lead bytes C0-DE to
    E0-FE, but the number of continuation bytes behind a lead byte tells them apart, so distinct valid UTF-8 strings
    stay distinct. All bytes beyond ASCII stay beyond it, and ASCII bytes keep their places: word patterns and line
    ends of ASCII find the same words and lines. (``translate`` would do the same at three times the cost.)
    """
    return F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def hash128(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only where it is unset (tests), a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str | None = None, **options: object) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors, and
    gives Spark true sizes to plan with."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.options(**options).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "written_path", None)):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def sized_join_hint(small: DataFrame, rows: int, limit: int, beyond: str = "merge") -> DataFrame:
    """``small`` with a join hint: broadcast if its counted ``rows`` are within ``limit``, else ``beyond``."""
    return F.broadcast(small) if rows <= limit else small.hint(beyond)


def hf_path(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder, for tasks that write their own file formats."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
