"""Lines of large text files, read by many tasks: their numbers, and records that span lines.

A task reads one or more splits of files and knows neither the line it begins at nor whether it
begins inside a quoted field. Both follow from figures per split (lines, quotes), summed over
the splits before it. That table has one row per split, so the text itself is never shuffled.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldgauge.session import scratch_path, shared_dir

#: Split tables up to this many rows are broadcast, about 10 MB; larger ones are joined.
BROADCAST_SPLITS = 100_000
QUOTE = '"'
_WHOLE, _OPENS, _INSIDE, _CLOSES = range(4)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (where the split begins) and at, which ascends within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))


def split_table(lines: DataFrame) -> DataFrame:
    """Per split: file, block, first (its first ``at``), before (lines of its file before it) and
    inside (whether it begins inside a quoted field)."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    return lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"),
        F.sum(quotes).alias("quotes")).select(
        "file", "block", "first", "lines", F.coalesce(F.sum("lines").over(earlier), F.lit(0))
        .alias("before"),
        (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))


def _if_small(splits: DataFrame) -> DataFrame:
    few = splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    return F.broadcast(splits) if few else splits


def numbered_lines(spark: SparkSession, path: str, one_file: bool = False) -> DataFrame:
    """file, line (from 1) and value of every line. ``one_file`` refuses several files, whose
    lines have no common order."""
    lines = text_lines(spark, path)
    splits = split_table(lines)
    if one_file:
        names = [r.file for r in splits.select("file").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError(f"{path} holds several files; their lines have no common order")
    splits = _if_small(splits.select(F.col("file").alias("f"), F.col("block").alias("b"),
                                     "first", "before"))
    return lines.join(splits, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))) \
        .select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def _checked_header(record: str, columns: Sequence[str]) -> None:
    found = next(csv.reader([record.removeprefix("﻿").removesuffix("\r")]))
    if [c.strip().lower() for c in found] != [c.lower() for c in columns]:
        raise ValueError(f"the header {found} is not {list(columns)}")


class _Cutter:
    """Cuts the lines of one task into records, split by split."""

    def __init__(self, inside: set, columns: Sequence[str]):
        self.inside_at_start, self.columns = inside, columns
        self.split = None
        self.out: list[tuple] = []

    def begin(self, split: tuple) -> None:
        self.close()
        self.split, self.row = split, 0
        self.odd = split in self.inside_at_start
        # Lines of a record that is not complete yet, and where its first line stands.
        self.held: list[str] = []
        self.held_row, self.own = 0, not self.odd

    def emit(self, row: int, kind: int, record: str) -> None:
        if self.split[1] == 0 and row == 0 and kind == _WHOLE:
            _checked_header(record, self.columns)
        else:
            self.out.append((*self.split, row, kind, record))

    def add(self, values: pa.Array) -> None:
        quotes = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.odd) % 2 == 1
        before = np.concatenate([[self.odd], after[:-1]])
        starts = np.flatnonzero(~before)
        first = int(starts[0]) if len(starts) else len(values)
        if first:  # the rest of a record begun earlier
            self.held += values[:first].to_pylist()
            if not after[first - 1]:
                self.emit(self.held_row, _WHOLE if self.own else _CLOSES, "\n".join(self.held))
                self.held, self.own = [], True
        if len(starts):
            bounds = np.append(starts, len(values))
            joined = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(bounds - first, pa.int32()), values[first:]), "\n").to_pylist()
            if after[-1]:  # the last one goes on
                self.held, self.held_row = [joined.pop()], self.row + int(starts[-1])
            for row, record in zip((self.row + starts).tolist(), joined):
                self.emit(row, _WHOLE, record)
        self.odd = bool(after[-1])
        self.row += len(values)

    def close(self) -> None:
        """What is left at the end of a split goes on in the next one."""
        if self.split is not None and self.held:
            self.emit(self.held_row, _OPENS if self.own else _INSIDE, "\n".join(self.held))
        self.split, self.held = None, []

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * 5
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])],
            names=["file_key", "block", "row", "kind", "record"])


def csv_records(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """file, line (of its first line, from 1) and record of every record of headed CSV files;
    quoted fields may hold line breaks, and a quote inside one is doubled.

    Every split is cut by its own task. A quote character opens or closes a field wherever it
    stands, so whether a split begins inside a field is the parity of the quotes before it. The
    pieces of a record that crosses splits, two or fewer per split, are put together afterwards.
    The records are written once to the shared folder, so the returned table reads them from there.
    The splits that begin inside a field are sent to the tasks, 16 bytes each. The header of each
    file must name ``columns``; blank records are left out.
    """
    lines = text_lines(spark, path)
    key = F.xxhash64("file")
    shared_dir(spark)
    splits = split_table(lines).withColumn("file_key", key).checkpoint()  # a row per split
    if splits.groupBy("file_key").agg(F.count_distinct("file").alias("n")).where("n > 1").count():
        raise ValueError("two file names share a hash; read them apart")
    inside = {(r.file_key, r.block) for r in
              splits.where("inside").select("file_key", "block").toLocalIterator()}
    sent = spark.sparkContext.broadcast(inside)
    names = list(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(sent.value, names)
        for batch in batches:
            values = batch.column(0)
            places = [c.to_numpy() for c in batch.columns[1:]]
            changes = np.flatnonzero((np.diff(places[0]) != 0) | (np.diff(places[1]) != 0)) + 1
            bounds = [0, *changes.tolist(), len(values)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                split = (int(places[0][a]), int(places[1][a]))
                if split != cutter.split:
                    cutter.begin(split)
                cutter.add(values[a:b])
            yield cutter.taken()
        cutter.close()
        yield cutter.taken()

    found = lines.select("value", key.alias("file_key"), "block").mapInArrow(
        cut, "file_key long, block long, row long, kind long, record string")
    # Cut once; whole records and pieces are read from it.
    path = scratch_path(spark, "records")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    whole = found.where(F.col("kind") == _WHOLE).select("file_key", "block", "row", "record")
    order = Window.partitionBy("file_key").orderBy("block", "row")
    crossing = (
        found.where(F.col("kind") != _WHOLE)
        .withColumn("nth", F.count_if(F.col("kind") == _OPENS).over(order))
        .groupBy("file_key", "nth").agg(F.array_sort(F.collect_list(
            F.struct("block", "row", "record"))).alias("parts"))
        .select("file_key", F.col("parts")[0]["block"].alias("block"),
                F.col("parts")[0]["row"].alias("row"),
                F.array_join(F.col("parts.record"), "\n").alias("record"))
        .where("block > 0 OR row > 0")  # a header over several splits
    )
    places = _if_small(splits.select(F.col("file_key").alias("k"), F.col("block").alias("b"),
                                     "file", "before"))
    records = whole.unionByName(crossing)
    return records.join(places, (F.col("file_key") == F.col("k")) & (F.col("block") == F.col("b"))) \
        .select("file", (F.col("before") + F.col("row") + 1).alias("line"),
                F.regexp_replace("record", r"\r$", "").alias("record")) \
        .where(F.trim("record") != "")
