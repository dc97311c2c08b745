"""A table of the newest rows per key, merged batch by batch in place.

Keys are hashed into a fixed number of buckets. A bucket has two slots; a batch rewrites only
the buckets that it touches, each into the slot that is not in use, and then commits a list of
the slots in use, itself in one of two places. So the number of files depends on the buckets
alone, a batch that fails leaves the table as it was, and one that is run again replaces its own
files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_BUCKET, _SLOT = "bucket__", "slot__"


class CurrentTable:
    """``keys`` name a row, or a group of rows that is replaced as a whole.

    A bucket is one file written by one task; choose ``buckets`` so that it fits, say a million
    keys each. Later batches have larger numbers; a batch below the last committed one
    (``low_water``) is left out, for its rows are in the table already.
    """

    def __init__(self, path: str, keys: Sequence[str], buckets: int = 16):
        self.path, self.keys, self.buckets = path, list(keys), buckets

    def _commits(self, spark: SparkSession) -> list[dict]:
        found = []
        for place in (0, 1):
            try:
                rows = spark.read.text(f"{self.path}/commits/place={place}").collect()
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            found += [json.loads(r.value) for r in rows]
        return sorted(found, key=lambda c: c["batch"])

    def low_water(self, spark: SparkSession) -> int:
        """The last committed batch, -1 before the first."""
        return max((c["batch"] for c in self._commits(spark)), default=-1)

    def note(self, spark: SparkSession, before: int | None = None) -> dict:
        """What the last commit, or the last one before a batch, was told to keep."""
        commits = [c for c in self._commits(spark) if before is None or c["batch"] < before]
        return commits[-1]["note"] if commits else {}

    def _read(self, spark: SparkSession, commit: dict, only: set[int] | None = None
              ) -> DataFrame | None:
        slots = {int(b): s for b, s in commit["slots"].items()}
        paths = [f"{self.path}/data/{_BUCKET}={b}/{_SLOT}={s}" for b, s in sorted(slots.items())
                 if only is None or b in only]
        return spark.read.schema(commit["schema"]).parquet(*paths) if paths else None

    def read(self, spark: SparkSession) -> DataFrame:
        commits = self._commits(spark)
        if not commits:
            raise ValueError(f"no batch was committed to {self.path}")
        found = self._read(spark, commits[-1])
        return spark.createDataFrame([], commits[-1]["schema"]) if found is None else found

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _same(self):
        """Whether a row's keys are those named, whose columns end in two underscores."""
        return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__"))
                                           for k in self.keys])

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(k).alias(f"{k}__") for k in self.keys]).distinct()

    def rows_of(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """The rows that the keys of a batch had before it; only their buckets are read."""
        spark = batch.sparkSession
        before = [c for c in self._commits(spark) if c["batch"] < batch_id]
        if not before:
            return None
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}
        held = self._read(spark, before[-1], touched)
        if held is None:
            return None
        named = self._named(batch)
        return held.join(named, self._same(), "left_semi")

    def merge(self, batch: DataFrame, batch_id: int, note: dict | None = None,
              combine: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Replace the rows of the batch's keys; with ``combine``, the rows of both the table and
        the batch go through it, which gives one row per key. ``note`` is kept with the commit."""
        spark = batch.sparkSession
        commits = self._commits(spark)
        if commits and commits[-1]["batch"] > batch_id:
            return
        before = [c for c in commits if c["batch"] < batch_id]
        base = before[-1] if before else {"slots": {}, "schema": batch._jdf.schema().toDDL(),
                                          "note": {}}
        bucket = self._bucket()
        batch = batch.persist()
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        slots = {int(b): s for b, s in base["slots"].items()}
        new, held = batch, self._read(spark, base, touched & set(slots)) if slots else None
        if held is not None:
            if combine is None:
                named = self._named(batch)
                held = held.join(named, self._same(), "left_anti")
            new = batch.unionByName(held)
        if combine is not None:
            new = combine(new)
        slots |= {b: 1 - slots.get(b, 1) for b in touched}
        if touched:
            turned = F.array(*[F.lit(slots.get(b, 0)) for b in range(self.buckets)])
            (new.withColumn(_BUCKET, bucket)
             .withColumn(_SLOT, F.get(turned, F.col(_BUCKET)))
             .repartition(_BUCKET).write.partitionBy(_BUCKET, _SLOT)
             .option("partitionOverwriteMode", "dynamic").mode("overwrite")
             .parquet(f"{self.path}/data"))
        commit = {"batch": batch_id, "slots": slots, "schema": base["schema"],
                  "note": base["note"] if note is None else note}
        spark.createDataFrame([(json.dumps(commit),)], "value string").coalesce(1).write \
            .mode("overwrite").text(f"{self.path}/commits/place={batch_id % 2}")
        batch.unpersist()
