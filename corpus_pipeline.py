"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

run(spark, sf_dir) applies STAGES in order.  Every stage is a function (spark, docs, sf_dir)
that works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import stages
from rasterloom.llm.common import shared_folder

STAGES = [
    ("language", stages.language),
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("mix", stages.mix),
    ("tokens", stages.tokens),
]

# Hyperdimensional prototypes, estimated rules, hashed darts and merge replay have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
