"""Loaders that divide their input: rows whose every field has its type, and rejects with the
file, the line, the reason and the text."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fieldgauge.session import scratch_path
from fieldgauge.sources.lines import QUOTE, csv_records, numbered_lines

#: Columns of a table of rejects.
REJECTS = ["file", "line", "reason", "record"]


class Loaded(NamedTuple):
    """Rows of the wanted schema, and the records that are none."""
    rows: DataFrame
    rejects: DataFrame


def _divided(records: DataFrame, fields: list[Column], count_reason: Column,
             schema: T.StructType, staged: bool) -> Loaded:
    """records: file, line, record. A missing field is NULL; any other one that its type does
    not take makes the record a reject, named after the first such column."""
    values, reasons = [], [count_reason]
    for text, field in zip(fields, schema.fields):
        value = text if field.dataType == T.StringType() else text.try_cast(field.dataType)
        values.append(value.alias(field.name))
        reasons.append(F.when(text.isNotNull() & value.isNull(),
                              F.lit(f"{field.name}: not {field.dataType.simpleString()}")))
    judged = records.select("file", "line", "record", F.coalesce(*reasons).alias("reason"),
                            F.struct(*values).alias("row"))
    if staged:  # parsed once; both tables read the result
        judged = judged.withColumn("record", F.when(F.col("reason").isNotNull(), F.col("record")))
        path = scratch_path(records.sparkSession, "loaded")
        judged.write.parquet(path)
        judged = records.sparkSession.read.schema(judged.schema).parquet(path)
    return Loaded(judged.where("reason IS NULL").select("row.*"),
                  judged.where("reason IS NOT NULL").select(*REJECTS))


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def load_csv_checked(spark: SparkSession, path: str, schema: str | T.StructType,
                     staged: bool = False) -> Loaded:
    """Headed CSV files whose fields may hold line breaks, split among many tasks.

    An empty field is NULL, quoted or not; line breaks inside a field stay as they are. Records with too few or too many
    fields, with a quote left open, or with a field that its type does not take are rejects; so
    rows and rejects together are all records. ``staged`` writes the parsed records once.
    """
    schema = _schema(schema)
    records = csv_records(spark, path, schema.fieldNames())
    texts = ", ".join([*(f"c{i} string" for i in range(len(schema))), "bad string"])
    parsed = records.withColumn("p", F.from_csv("record", texts, {
        "escape": QUOTE, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad",
        "maxCharsPerColumn": "-1"}))
    quotes = F.length("record") - F.length(F.replace("record", F.lit(QUOTE), F.lit("")))
    counted = F.when(quotes % 2 == 1, "quote left open").when(
        F.col("p.bad").isNotNull(), f"not {len(schema)} fields")
    return _divided(parsed, [F.col(f"p.c{i}") for i in range(len(schema))], counted, schema,
                    staged)


def load_whitespace_checked(spark: SparkSession, path: str, columns: Mapping[str, str],
                            staged: bool = False) -> Loaded:
    """Header-less text of fields separated by blanks; blank lines are neither row nor reject."""
    schema = _schema(", ".join(f"`{name}` {kind}" for name, kind in columns.items()))
    lines = numbered_lines(spark, path).withColumnRenamed("value", "record") \
        .where(F.trim("record") != "").withColumn("f", F.split(F.trim("record"), r"\s+"))
    counted = F.when(F.size("f") != len(schema), f"not {len(schema)} fields")
    return _divided(lines, [F.get("f", F.lit(i)) for i in range(len(schema))], counted, schema,
                    staged)
