"""A training corpus from raw documents, in stages that each apply one operator.

Toxic documents, exact copies, near copies and documents with benchmark passages go, in this
order; what is left is packed into training sequences. Each stage judges what its predecessor
kept, and its result is written to the shared folder before the next one reads it. Each row is judged
by its own text, as identifiers may be missing or repeated. A stage frees what its predecessors have
staged, but for what its input still reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import toxicity
from gristmill.llm.common import free_staged, keyed, only, staged
from gristmill.llm.contamination import clean_rows
from gristmill.llm.exact import drop_copies
from gristmill.llm.nearcopies import near_copies
from gristmill.llm.packing import pack

TOKENIZER = "byte_bpe_50k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learnt(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_staged(docs)
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest identifier stays; one without any comes last."""
    free_staged(docs)
    rows = keyed(docs, "row__key")
    verdict = near_copies(rows, "row__key").select(F.col("doc_id").alias("row__key"), "component_id")
    named = verdict.join(rows.select("row__key", "doc_id"), "row__key")
    best = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "row__key")).alias("best")
    return only(rows, "row__key", named.groupBy("component_id").agg(best).select("best.row__key"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_staged(docs)
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_staged(docs)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# The stages learn, sign and tokenise, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
