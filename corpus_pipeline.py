"""Corpus pipeline: toxic documents go, one document of each near-duplicate class stays, personal
data is masked, and what is left is packed into windows.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last
return the columns of the documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rowflow.llm import bagminhash, packing, pii, toxicity  # noqa: E402
from rowflow.llm.queries import byte_level, table, tokenizer  # noqa: E402
from rowflow.session import scratch_path  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the severity model doesn't call toxic; it is fitted on the labels. Null and
    empty texts stay, repeated rows stay or go together, other columns are kept, whatever their
    names; without labels of both kinds everything stays."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest id (then text_key), or one
    without an id if the class has no other; of its repeats the smallest by its columns."""
    rows = docs.withColumn("kept key", bagminhash.text_key())
    kept = bagminhash.classified(docs).where("chosen").select(F.col("doc_id").alias("kept id"), F.col("text_key").alias("kept text")).distinct()
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept id")) & (F.col("kept key") == F.col("kept text")), "left_semi")
    first = rows.groupBy("doc_id", "kept key").agg(F.min(F.struct(*(c for c in docs.columns if c != "doc_id"))).alias("rest"))
    return first.select(*("doc_id" if c == "doc_id" else F.col(f"rest.{c}").alias(c) for c in docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every personal identifier replaced by its kind in brackets, those found by contexts by [ID].
    Null texts and texts without any stay as they are, repeated rows change alike, other columns
    are kept; n_chars follows the text where it is there."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens. A null text has its end token alone, rows
    without an id and repeated rows are documents of their own; other columns are not used."""
    return packing.pack(docs, byte_level(tokenizer("byte_bpe_50k.json"), 1))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("pii", mask_personal_data), ("packing", pack)]
#: No SQL: the model, the signatures and the tokenizer have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage; every stage is written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
