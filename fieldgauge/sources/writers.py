"""Sinks. Tables are written by all executors; only a report document is one file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_scores(df: DataFrame, path: str, columns: Sequence[str], *, fmt: str = "parquet",
                 partition_by: Sequence[str] = ()) -> None:
    """Write the named columns for the next job."""
    writer = df.select(*columns).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def _jsonable(df: DataFrame, column: str) -> Column:
    """Numbers, booleans and texts as they are; everything else as text."""
    kind = dict(df.dtypes)[column]
    plain = ("string", "boolean", "double", "float", "int", "bigint", "smallint", "tinyint")
    value = F.col(column)
    if kind not in plain and not kind.startswith(("decimal", "array", "struct", "map")):
        value = value.cast("string")
    return value.alias(column)


def records(df: DataFrame, order: Sequence[str | Column] = (),
            name: str = "records") -> DataFrame:
    """All rows of a small report as one array, in a fixed order. One row comes back.

    Reports are aggregates with few rows; this is not meant for row-level tables.
    """
    row = F.struct(*[_jsonable(df, c) for c in df.columns])
    key = F.struct(*order) if order else F.struct(F.lit(0))
    entries = df.select(F.struct(key.alias("key"), row.alias("row")).alias("e"))
    gathered = F.array_sort(F.collect_list("e"))
    return entries.agg(F.transform(gathered, lambda e: e["row"]).alias(name))


def report_document(spark: SparkSession, report: str,
                    sections: Mapping[str, DataFrame]) -> DataFrame:
    """One JSON text for a report: a single-row section per entry, keyed by report name.

    Each section must already be one row (an aggregate, or the output of ``records``); a
    section with one column keeps only its value.
    """
    values = []
    for name, df in sections.items():
        if len(df.columns) > 1:
            df = df.select(F.struct(*[_jsonable(df, c) for c in df.columns]))
        values.append(df.scalar().alias(name))
    return spark.range(1).select(
        F.lit(report).alias("report"),
        F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("document"))


def write_report(document: DataFrame, path: str) -> None:
    """Write report documents as text, one folder per report name."""
    document.write.mode("overwrite").partitionBy("report").text(path)
