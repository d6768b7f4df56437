"""From raw documents to packed sequences, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import stages
from lorewell.llm.shared import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.language_id),
    ("simhash_dedup", stages.simhash_dedup),
    ("secret_scan", stages.secret_scan),
    ("mix_sources", stages.mix_sources),
    ("best_fit_packing", stages.best_fit_packing),
]
# No stage but the last filter is relational; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
