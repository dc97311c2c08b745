"""Remaining-life scoring of a stream of engine cycles.

Trailing windows are not allowed on a stream, so each micro-batch is scored as a batch
together with the last rows of its units, which are kept as a table in buckets: only the buckets
of the batch's units are read and written. A unit that sends most rows of a batch is split like
in any batch job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.functions import columns as fx
from fieldgauge.operators.features import WINDOW_ROWS, rolling_features
from fieldgauge.operators.ordered import last_n_rows, last_row
from fieldgauge.plans.forecast import respond
from fieldgauge.streaming.current import CurrentTable
from fieldgauge.streaming.monitor import BATCH


def request_error(unit: str, cycle: str, columns: Sequence[str]) -> Column:
    """Why a row cannot be scored; NULL for a good one. The unit may be missing."""
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        value = F.col(c).cast("double")
        out = F.when(value.isNull() | F.isnan(value), f"{c} is missing").otherwise(out)
    return F.when(F.col(cycle).isNull() | (F.col(cycle) < 1),
                  f"{cycle} must be 1 or more").otherwise(out)


_ARRIVAL, _ENTITY = "__arrival", "__entity"


def judge_requests(requests: DataFrame, columns: Sequence[str], *, unit: str, cycle: str,
                   request: str | None = None) -> DataFrame:
    """Every request with the series it belongs to and an ``error``, NULL for a good one.

    A request without a unit is a series of its own. Of several for one unit and cycle the
    newest counts, as a whole row; the others are told that their cycle was sent again.
    """
    arrival = F.col(request) if request else F.monotonically_increasing_id()
    rows = requests.withColumn(_ARRIVAL, arrival).withColumn(
        _ENTITY, F.when(F.col(unit).isNull(), F.concat(F.lit("request "), F.col(_ARRIVAL)))
        .otherwise(F.concat(F.lit("unit "), F.col(unit).cast("string"))))
    rows = rows.withColumn("error", request_error(unit, cycle, columns))
    newest = Window.partitionBy(_ENTITY, cycle, F.col("error").isNull()).orderBy(
        F.col(_ARRIVAL).desc())
    return rows.withColumn("error", F.when(
        F.col("error").isNull() & (F.row_number().over(newest) > 1),
        f"{cycle} was sent again").otherwise(F.col("error")))


def score_requests(model: PipelineModel, requests: DataFrame, columns: Sequence[str], *,
                   unit: str, cycle: str, version: str, request: str | None = None,
                   horizon: float = fx.FAILURE_HORIZON) -> tuple[DataFrame, DataFrame]:
    """Answers and rejects of a table of requests; each request is in one of them."""
    judged = judge_requests(requests, columns, unit=unit, cycle=cycle, request=request)
    named = [request] if request else []
    good = judged.filter(F.col("error").isNull())
    featured = rolling_features(good, columns, unit=_ENTITY, cycle=cycle)
    answers = respond(model, featured, unit=unit, cycle=cycle, version=version, horizon=horizon,
                      keep=named)
    bad = judged.filter(F.col("error").isNotNull()).select(*named, unit, cycle, *columns, "error")
    return answers, bad


@dataclass(frozen=True)
class ScoringJob:
    """Where a scoring stream keeps its answers, rejected rows and last rows per unit.

    ``request`` names the column that tells requests apart; answers and rejects carry it.
    Every request is answered or rejected with a reason.
    """

    model: PipelineModel
    version: str
    folder: str
    unit: str
    cycle: str
    columns: tuple[str, ...]
    horizon: float = fx.FAILURE_HORIZON
    request: str | None = None
    buckets: int = 64

    def _held(self) -> CurrentTable:
        """The last rows of every unit; a repeated batch finds them as they were before it."""
        return CurrentTable(f"{self.folder}/held", [self.unit], self.buckets)

    def score_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Answer for every good request of the batch."""
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        named = [self.request] if self.request else []
        kept = [*named, self.unit, self.cycle, *self.columns]
        judged = judge_requests(batch.select(*kept), self.columns, unit=self.unit,
                                cycle=self.cycle, request=self.request)
        known = batch.where(F.col(self.unit).isNotNull())
        held = self._held().rows_of(known, batch_id)
        if held is not None:
            seen = held.groupBy(F.col(self.unit).alias("__unit")).agg(
                F.max(self.cycle).alias("__seen"))
            late = F.col("error").isNull() & (F.col(self.cycle) <= F.col("__seen"))
            judged = judged.join(seen, F.col(self.unit) == F.col("__unit"), "left").withColumn(
                "error", F.when(late, f"{self.cycle} is not after the last one answered")
                .otherwise(F.col("error"))).drop("__unit", "__seen")
        # Every pass below deals its rows from each of these partitions to all of a shuffle.
        cores = batch.sparkSession.sparkContext.defaultParallelism
        judged = judged.coalesce(2 * cores).persist(StorageLevel.MEMORY_AND_DISK)
        (judged.filter(F.col("error").isNotNull()).select(*kept, "error")
         .write.mode("overwrite").parquet(f"{self.folder}/rejects/{BATCH}={batch_id}"))
        rows = judged.filter(F.col("error").isNull()).select(
            *kept, _ENTITY, F.lit(True).alias("fresh"))
        if held is not None:
            rows = rows.unionByName(held.withColumn("fresh", F.lit(False)),
                                    allowMissingColumns=True)
        featured = rolling_features(rows, self.columns, unit=_ENTITY, cycle=self.cycle)
        answers = respond(self.model, featured.filter("fresh"), unit=self.unit,
                          cycle=self.cycle, version=self.version, horizon=self.horizon,
                          keep=named)
        answers.write.mode("overwrite").parquet(f"{self.folder}/answers/{BATCH}={batch_id}")
        self._held().merge(
            last_n_rows(rows.filter(F.col(self.unit).isNotNull()), [self.unit], [self.cycle],
                        WINDOW_ROWS).drop("fresh", *named), batch_id)
        for frame in (judged, batch):
            frame.unpersist()

    def run(self, stream: DataFrame) -> None:
        """Process what is there."""
        (stream.writeStream.foreachBatch(self.score_batch)
         .option("checkpointLocation", f"{self.folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())

    def answers(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/answers")

    def latest_answers(self, spark) -> DataFrame:
        """The answer to the newest cycle of every unit; of anonymous requests, the last one."""
        return last_row(self.answers(spark), [self.unit], [BATCH, self.cycle]).drop(BATCH)

    def rejects(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rejects")


def model_info(model: PipelineModel, version: str) -> dict[str, str]:
    """What the scoring service tells about its model."""
    regressor = model.stages[-1]
    settings = {p.name: str(v) for p, v in regressor.extractParamMap().items()}
    return {"model_version": version, "model": type(regressor).__name__, **settings}
