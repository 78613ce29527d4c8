"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import lines, lsa, mix, near, quality
from termloom.llm.common import scratch_path, table

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", near.stage),
    ("decontamination", lsa.stage),
    ("mixing", mix.stage),
]

#: The quality rules are learned and the latent space is fitted, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage's rows go through a table in shared scratch."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
