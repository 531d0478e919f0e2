"""The corpus pipeline: stages over ``documents``, each reading what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from purchaseflow.llm import stages
from purchaseflow.llm.common import staged

#: Each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.without_toxic),
    ("quality classifier", stages.with_quality),
    ("n-gram Jaccard join", stages.without_near_copies),
    ("substring dedup", stages.without_repeats),
    ("packing", stages.packed_pieces),
]

# Learned models, vocabulary ids and 64-bit text hashes have no SQL form: the stages are
# tested one by one against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{i}")
    return docs
