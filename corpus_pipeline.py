"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage gets the documents that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import near_dup, packing, quality, toxicity
from linkloom.llm.common import table, written

STAGES = [
    ("quality_rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("near_dup", near_dup.stage),
    ("packing", packing.stage),
]

#: Two stages are learned and one is hashed: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
