"""From documents to token ids: language, repeated lines, near duplicates, benchmark passages, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deviatix.llm.bpe import encode_decode
from deviatix.llm.common import sized_join_hint, table, written
from deviatix.llm.decontaminate import contamination
from deviatix.llm.language import predict, train
from deviatix.llm.line_dedup import drop_common_lines
from deviatix.llm.near_dup import near_duplicates
from deviatix.llm.queries import tokenizer_file

#: Removed rows (id and hash, counted) up to which the list of them is broadcast.
BROADCAST_ROWS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least_score: float = 0.3) -> DataFrame:
    """Drops documents in no language (null, or without a letter) or of which the network can't tell it."""
    found = predict(docs, train(docs), keep_row=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents or more share, which stay in one of them."""
    out = drop_common_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    gone = written(near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select(F.col("id").alias("gone_id")).distinct(), "duplicates")
    return docs.join(sized_join_hint(gone, gone.count(), BROADCAST_ROWS), F.col("doc_id") == F.col("gone_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where(F.col("n_hit") > 0)
    gone = written(found.select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gone_hash"))
    return docs.join(sized_join_hint(gone, gone.count(), BROADCAST_ROWS), same, "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) with their digest and that of the text decoded from them."""
    out = encode_decode(docs, tokenizer_file("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dup", near_dup), ("decontaminate", decontaminate), ("tokens", tokens)]
#: SQL can't express the network, the near duplicates or BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each other stage is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
