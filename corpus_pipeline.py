"""A training corpus from raw documents: toxic ones out, poor ones out, one of each group of
near copies, sources mixed to their weights, packed into sequences.

Every stage works on all rows that its predecessor kept. ``run`` writes each stage's rows as
Parquet to the shared folder (``spark.checkpoint.dir``) and reads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldgauge.llm import stages
from fieldgauge.llm.common import stored

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality classifier", stages.keep_good),
    ("near-duplicates", stages.one_of_each),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: Trained models, signatures and a tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
