"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspan.llm.common import written
from lumenspan.llm.queries import mixing_stage, near_dedup_stage, quality_stage, sentencepiece_stage, toxicity_stage

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: SQL can express neither the learned scores nor the token ids; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
