"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import queries as q
from callscope.llm import stages
from callscope.session import scratch_dir

#: Name and function of each stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("quality rules", stages.quality),
    ("language identification", stages.language),
    ("near-duplicates", stages.near_duplicates),
    ("source mixing", stages.mix),
    ("packing", stages.pack),
]

#: The log-likelihood ratio over hash buckets and the packing can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written as Parquet and read again."""
    docs = q.table(spark, sf_dir, "documents")
    root = scratch_dir(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        path = f"{root}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
