"""From raw documents to packed sequences, in stages that each keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import registry
from broadsheet.runtime import stage

#: Each takes (spark, docs, sf_dir); all but the last return rows of ``docs`` with its columns.
STAGES = [
    ("quality_classifier", registry.good_quality),
    ("quality_rules", registry.good_shape),
    ("near_duplicates", registry.one_of_each),
    ("decontamination", registry.without_benchmark),
    ("packing", registry.packed),
]

#: Trained weights, hashes and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
