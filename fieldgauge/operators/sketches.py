"""Distinct counts that add up: sketches per fine group, stored and merged upward.

Exact distinct counts of months do not add up to those of a year. A sketch per (month,
dimension) does: coarser groups are unions of stored sketches, a few kilobytes each, and no row
is read again. The standard error is about ``1.04 / sqrt(2 ** precision)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

PRECISION = 12


def standard_error(precision: int = PRECISION) -> float:
    """Relative, of a merged sketch."""
    return 1.04 / 2 ** (precision / 2)


def distinct_sketches(df: DataFrame, value: str, by: Sequence[str], *,
                      precision: int = PRECISION) -> DataFrame:
    """One sketch of the distinct values per group, with its row count.

    Sketches are made before the shuffle, so a hot group moves one sketch per task. NULL values
    count as no value; a NULL in ``by`` is a group.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"),
                               F.hll_sketch_agg(value, precision).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups; ``by`` may be empty for one of everything."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"),
                                     F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, out: str = "distinct") -> DataFrame:
    """Sketches replaced by their estimates."""
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")


def store(sketches: DataFrame, path: str, part: str) -> None:
    """Write sketches in one folder per value of ``part``. Parts that are written again are
    replaced, others stay: a month that arrives late or twice is rewritten alone."""
    (sketches.repartition(part).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))


def load(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The stored sketches; ``part`` comes back as text."""
    schema = spark.read.parquet(path).schema
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name != part]
    return spark.read.schema(", ".join([*columns, f"{part} string"])).parquet(path)
