"""Window means of a stream with a ledger of the rows that came too late.

A watermark inside a stateful query drops late rows unseen. Here the low-water mark is kept with
the table of windows: rows before it are split off first and appended to the ledger, the others
are added to their windows, so every row is in exactly one of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.streaming.current import CurrentTable
from fieldgauge.streaming.monitor import AVAILABLE_NOW, BATCH


@dataclass
class TrendLedger:
    """Means of ``value`` per window of ``length`` and ``by``, below ``path``.

    A row is late if its time is more than ``delay`` before the newest time of all earlier
    batches; rows without a time are late too, and never move the mark. Sums are exact for whole
    numbers and decimals. A batch that is run again replaces its own part of both tables.
    """

    path: str
    value: str
    by: Sequence[str]
    ts: str = "ts"
    length: str = "1 day"
    delay: str = "1 hour"
    buckets: int = 16
    windows: CurrentTable = field(init=False)

    def __post_init__(self) -> None:
        self.windows = CurrentTable(f"{self.path}/windows", ["window_start", *self.by],
                                    self.buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.windows.low_water(spark) > batch_id:
            return
        batch = batch.persist()
        newest = self.windows.note(spark, before=batch_id).get("newest")
        mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        in_time = F.col(self.ts).isNotNull()
        if newest is not None:
            in_time &= F.coalesce(F.col(self.ts) >= mark, F.lit(False))
        batch.where(~in_time).write.mode("overwrite").parquet(
            f"{self.path}/late/{BATCH}={batch_id}")
        span = F.window(self.ts, self.length)
        part = batch.where(in_time).groupBy(span.alias("w"), *self.by).agg(
            F.count(F.lit(1)).alias("rows"), F.count(self.value).alias("n"),
            F.sum(self.value).alias("total")).select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            *self.by, "rows", "n", "total")
        total = dict(part.dtypes)["total"]

        def added(rows: DataFrame) -> DataFrame:
            return rows.groupBy("window_start", "window_end", *self.by).agg(
                F.sum("rows").alias("rows"), F.sum("n").alias("n"),
                F.sum("total").cast(total).alias("total"))

        highest = batch.agg(F.max(self.ts).cast("timestamp").cast("string")).first()[0]
        moved = [t for t in (newest, highest) if t is not None]
        self.windows.merge(part, batch_id, note={"newest": max(moved, default=None)},
                           combine=added)
        batch.unpersist()

    def run(self, stream: DataFrame) -> None:
        """Process what is there."""
        (stream.writeStream.foreachBatch(self.process)
         .option("checkpointLocation", f"{self.path}/checkpoint")
         .trigger(**AVAILABLE_NOW).start().awaitTermination())

    def trend(self, spark: SparkSession) -> DataFrame:
        return self.windows.read(spark).withColumn(
            "mean_value", fx.ratio(F.col("total"), F.col("n"))).drop("total")

    def late(self, spark: SparkSession) -> DataFrame:
        """The late rows, with the batch that brought them."""
        return spark.read.parquet(f"{self.path}/late")
