"""Line dedup: lines that many documents share are dropped everywhere but in one document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folded_bytes, hash128, written

#: Hot lines at most: each holds at least this fraction of the exploded lines.
HOT_LINES = 1000
#: Stripped at both ends of a line.
SPACES = " \t\n\x0b\x0c\r"


def _line_hash(line: Column) -> Column:
    h1, h2 = hash128(folded_bytes(F.btrim(line, F.lit(SPACES))))
    return F.struct(h1.alias("h1"), h2.alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per input row: ``row`` (struct of the input's columns), ``n_lines``, ``n_dropped``, ``kept_text``.

    The lines of every document are exploded as 128-bit hashes of their normalised form (once per document) and
    counted by hash with map-side partial aggregates, which also bounds a line that a third of all documents hold.
    A hash in ``min_docs`` documents or more is dropped, except in the largest id that holds it. Hot hashes, a bounded
    number, are broadcast to the exploded lines; the others meet them by a merge join. The documents then
    filter their line arrays, which keeps positions, so that no text is exploded.

    Null or empty text: one empty line, kept. Rows that repeat an id each count as a document, and the largest id
    keeps its lines in all of its rows. A null id is smaller than any other; if only null ids hold a line, it stays.
    Other columns may have any name: they travel inside ``row``.
    """
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_lines = F.filter(_lines(F.col("text")), lambda x: F.length(F.btrim(x, F.lit(SPACES))) >= min_chars)
    keys = written(own.select("id", F.explode(F.array_distinct(F.transform(long_lines, _line_hash))).alias("h")).select("id", "h.h1", "h.h2"), "line-keys")
    common = written(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs), "common-lines")
    # a hot line holds a share of 1 in HOT_LINES of all keys or more, so there are HOT_LINES of them at most
    hot = F.col("docs") >= F.greatest(F.lit(min_docs), F.ceil(F.lit(keys.count() / HOT_LINES)))
    few, many = F.broadcast(common.where(hot)), common.where(~hot).hint("merge")
    line = ["h1", "h2"]
    met = keys.join(few, line).unionByName(keys.join(few.select(line), line, "left_anti").join(many, line))
    lost = met.where(F.col("id").isNull() & F.col("keeper").isNotNull() | (F.col("id") < F.col("keeper")))
    lost = lost.groupBy(F.col("id").alias("lost_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    both = own.join(lost.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("lost_id")), "left")
    lines = _lines(F.col("text"))
    stays = lambda x: (F.length(F.btrim(x, F.lit(SPACES))) < min_chars) | ~F.array_contains(F.col("lost"), _line_hash(x))
    kept = F.when(F.col("lost").isNull(), lines).otherwise(F.filter(lines, stays))
    both = both.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return both.select("row", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
