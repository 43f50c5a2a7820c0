"""Corpus pipeline: quality rules, n-gram Jaccard join, secret scans, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import ngram_join, packing, quality, secrets
from granary.llm.common import materialize, table

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("secret scans", secrets.stage),
    ("packing", packing.stage),
]

#: Tokenization and hashing have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
