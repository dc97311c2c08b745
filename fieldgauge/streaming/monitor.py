"""Equipment monitoring as Structured Streaming queries.

Event time and a watermark replace the wall clock: readings later than the watermark are left
out of windows, while statuses and alerts are given for every reading.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fieldgauge.functions import columns as fx
from fieldgauge.operators.ordered import last_n_rows
from fieldgauge.streaming.current import CurrentTable

WATERMARK = "1 hour"
BUFFER_ROWS = 20
WEAR_PER_STEP = 1.5  # tool wear added by one step, in minutes
BATCH = "batch_id"
AVAILABLE_NOW = {"availableNow": True}
CHUNK_ROWS = 1 << 17  # readings that a task sorts at a time
PACK_ROWS = 256  # readings in one packed row of a buffer's output
_DEVICE, _GROUP, _PACKED, _SENT = "device__", "group__", "packed__", "sent__"


def table_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as an unbounded table."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def with_event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Zone-less times as instants, which watermarks need; arrival time is kept beside it."""
    return (stream.withColumn(ts, F.col(ts).cast("timestamp"))
            .withColumn("received_at", F.current_timestamp()))


# --- stateless -----------------------------------------------------------

def with_status(readings: DataFrame, **limits) -> DataFrame:
    """Status and alert message of each reading; for batches and streams."""
    status = fx.equipment_status("health", "temperature", "torque", **limits)
    return readings.withColumn("status", status).withColumn(
        "message", fx.alert_text("status", "temperature", "torque"))


def alerts(readings: DataFrame, **limits) -> DataFrame:
    """Readings that need attention."""
    return with_status(readings, **limits).filter(F.col("status") != fx.NORMAL)


# --- built-in aggregates -------------------------------------------------

def trend(readings: DataFrame, value: str, by: Sequence[str], *, length: str = "1 day",
          slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Mean of a sensor per time window, tumbling or sliding; sums stay exact for decimals."""
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return readings.groupBy(span.alias("w"), *by).agg(
        F.count(value).alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n",
        fx.ratio(F.col("total"), F.col("n")).alias("mean_value"))


def trend_stream(readings: DataFrame, value: str, by: Sequence[str], *, ts: str = "ts",
                 watermark: str = WATERMARK, **window) -> DataFrame:
    """The same trend over a stream, for update mode: a window's newest row counts, so the
    windows that are still open are there as well."""
    return trend(readings.withWatermark(ts, watermark), value, by, ts=ts, **window)


def latest_reading(readings: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest reading of each device, for update mode."""
    newest = readings.groupBy(key).agg(
        F.max_by(F.struct(*readings.columns), F.struct(*order)).alias("r"))
    return newest.select("r.*")


def step_counter(readings: DataFrame, key: str) -> DataFrame:
    """Readings so far and the tool wear they add up to, for update mode."""
    return readings.groupBy(key).agg(F.count(F.lit(1)).alias("steps")).withColumn(
        "tool_wear", F.col("steps") * F.lit(WEAR_PER_STEP))


def distinct_readings(readings: DataFrame, keys: Sequence[str], *, ts: str = "ts",
                      watermark: str = WATERMARK) -> DataFrame:
    """Repeated readings dropped as they come, as long as they arrive within the watermark."""
    return readings.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


# --- keyed state ---------------------------------------------------------

def _newest(rows: pa.Table, key: str, order: Sequence[str], n: int) -> pa.Table:
    """The last ``n`` rows of each device, nulls being one device, in the order of ``order``."""
    rows = rows.combine_chunks()
    devices = rows[key].combine_chunks().dictionary_encode(null_encoding="encode").indices
    rows = rows.append_column(_DEVICE, devices).sort_by(
        [(c, "ascending") for c in (_DEVICE, *order)])
    numbers = rows[_DEVICE].to_numpy()
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]])
    # The place of a row before the end of its device's run.
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(numbers))
    return rows.filter(pa.array(left <= n)).drop_columns(_DEVICE)


def _cut(batches: Iterator[pa.RecordBatch], key: str, order: Sequence[str], n: int
         ) -> Iterator[pa.Table]:
    """A task's rows, cut to ``n`` per device ``CHUNK_ROWS`` rows at a time."""
    waiting, count = [], 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= CHUNK_ROWS:
            held = _newest(pa.Table.from_batches(waiting), key, order, n)
            waiting, count = held.to_batches(), held.num_rows
            # Rows are held on to as long as every cut halves them: no row is sorted often.
            if count > CHUNK_ROWS // 2:
                yield held
                waiting, count = [], 0
    if count:
        yield _newest(pa.Table.from_batches(waiting), key, order, n)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(packed)).read_all()


class _LastRows(StatefulProcessor):
    """The last rows of a group's devices, as one packed table in the state store."""

    def __init__(self, key: str, order: Sequence[str], n: int, idle_ms: int | None):
        self.key, self.order, self.n, self.idle_ms = key, list(order), n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", f"{_PACKED} binary",
                                         ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        fresh, waiting, count = None, [], 0
        for frame in rows:
            for packed in frame[_PACKED]:
                waiting.append(_unpacked(packed))
                count += waiting[-1].num_rows
                # Cut once the new rows are as many as those that a cut left.
                if count >= max(CHUNK_ROWS, 2 * (fresh.num_rows if fresh else 0)):
                    fresh = _newest(pa.concat_tables(waiting), self.key, self.order, self.n)
                    waiting, count = [fresh], fresh.num_rows
        fresh = pa.concat_tables(waiting)
        fresh = fresh.append_column(_SENT, pa.array(np.full(len(fresh), now, "int64")))
        held = self.rows.get()
        both = fresh if held is None else pa.concat_tables(
            [_unpacked(held[0]), fresh], promote_options="default")
        if held is not None and self.idle_ms:
            both = both.filter(pc.greater(both[_SENT], now - self.idle_ms))
        both = _newest(both, self.key, self.order, self.n)
        # All rows of a device bear the time at which it sent last.
        sent = pc.is_in(both[self.key], value_set=fresh[self.key].combine_chunks().unique())
        both = both.set_column(both.schema.get_field_index(_SENT), _SENT,
                               pc.if_else(sent, now, both[_SENT]))
        self.rows.update((_packed(both),))
        changed = both.filter(sent).drop_columns(_SENT)
        for start in range(0, len(changed), PACK_ROWS):
            yield pd.DataFrame({_PACKED: [_packed(changed.slice(start, PACK_ROWS))]})

    def close(self) -> None:
        pass


def buffer_stream(readings: DataFrame, key: str, order: Sequence[str], *, n: int = BUFFER_ROWS,
                  idle_ms: int | None = None, groups: int = 1024) -> DataFrame:
    """The last ``n`` readings of each device, for update mode: all of them whenever one is new.

    Every task first cuts its part of the batch, ``CHUNK_ROWS`` rows at a time, to ``n`` rows per
    device, so a device that sends most rows brings few of them to its state. Devices are hashed
    into ``groups``; the state in RocksDB is one packed table per group, of ``n`` rows per device,
    and a batch reads and writes the tables of the groups that it touches. Choose ``groups`` so
    that one fits, say some thousand devices each, and keep it for the life of a checkpoint. With
    ``idle_ms``, devices that send nothing for that long are forgotten.
    """
    columns, schema = readings.columns, readings.schema

    def pack(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by(_GROUP)
        numbers = rows[_GROUP].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1])
        ends = np.append(starts[1:], len(numbers))
        rows = rows.select(columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[starts], pa.int32()),
             pa.array([_packed(rows.slice(a, z - a)) for a, z in zip(starts, ends)], pa.binary())],
            names=[_GROUP, _PACKED])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut(batches, key, order, n):
            yield from pack(rows)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                yield from _unpacked(packed.as_py()).to_batches()

    group = F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")
    return readings.withColumn(_GROUP, group) \
        .mapInArrow(cut, f"{_GROUP} int, {_PACKED} binary").groupBy(_GROUP) \
        .transformWithStateInPandas(_LastRows(key, order, n, idle_ms), f"{_PACKED} binary",
                                    "Update", "ProcessingTime" if idle_ms else "None") \
        .mapInArrow(unpack, schema)


# --- sinks ---------------------------------------------------------------

def start_append(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished rows to a table; by default, process what is there and stop."""
    return (stream.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def start_update(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str],
                 buckets: int = 16, **trigger) -> StreamingQuery:
    """Merge the changed rows of each batch into a table of the newest rows of every key; by
    default, process what is there and stop."""
    return (stream.writeStream.outputMode("update")
            .foreachBatch(CurrentTable(path, keys, buckets).merge)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    start_append(stream, path, checkpoint).awaitTermination()


def run_update(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str],
               buckets: int = 16) -> None:
    start_update(stream, path, checkpoint, keys, buckets).awaitTermination()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest rows of each key written by ``run_update``."""
    return CurrentTable(path, []).read(spark)


def append_readings(buffer: DataFrame, fresh: DataFrame, key: str, order: Sequence[str],
                    n: int = BUFFER_ROWS) -> DataFrame:
    """A batch of new readings added to a buffer table, which keeps the last ``n`` per device."""
    return last_n_rows(buffer.unionByName(fresh), [key], order, n)


def closed_before(newest: Column, watermark: str = WATERMARK) -> Column:
    """The time up to which an append-mode window query has closed its windows."""
    return newest - F.expr(f"INTERVAL {watermark}")


# --- the whole monitor -----------------------------------------------------

def start_monitor(readings: DataFrame, folder: str, *, key: str, order: Sequence[str],
                  sensors: Sequence[str], length: str = "1 hour",
                  limits: dict | None = None, **trigger) -> list[StreamingQuery]:
    """Alerts, newest reading, step counter, last readings and sensor trends, side by side.

    Each runs on its own and keeps its own checkpoint below ``folder``. Pass
    ``processingTime="1 second"`` to keep them running.
    """
    def place(name: str) -> tuple[str, str]:
        return f"{folder}/{name}", f"{folder}/checkpoints/{name}"
    started = [
        start_append(alerts(readings, **(limits or {})), *place("alerts"), **trigger),
        start_update(latest_reading(readings, key, order), *place("latest"), [key], **trigger),
        start_update(step_counter(readings, key), *place("steps"), [key], **trigger),
        start_update(buffer_stream(readings, key, order), *place("buffer"), [key], **trigger)]
    started += [start_update(trend_stream(readings, sensor, [key], length=length),
                             *place(f"trend_{sensor}"), ["window_start", key], **trigger)
                for sensor in sensors]
    return started


def board(spark: SparkSession, folder: str, key: str, sensors: Sequence[str] = (),
          **limits) -> DataFrame:
    """The current state of every device, from the tables of a running monitor: its newest
    reading and status, steps, alerts so far, and the mean of each sensor's newest window."""
    out = with_status(read_latest(spark, f"{folder}/latest"), **limits)
    steps = read_latest(spark, f"{folder}/steps")
    raised = spark.read.parquet(f"{folder}/alerts").groupBy(key).agg(
        F.count_if(F.col("status") == fx.FAILURE_IMMINENT).alias("failures"),
        F.count_if(F.col("status") == fx.WARNING).alias("warnings"))
    out = out.join(steps, key).join(raised, key, "left").fillna(0, ["failures", "warnings"])
    for sensor in sensors:
        newest = read_latest(spark, f"{folder}/trend_{sensor}").groupBy(key).agg(
            F.max_by("mean_value", "window_start").alias(f"trend_{sensor}"))
        out = out.join(newest, key, "left")
    return out
