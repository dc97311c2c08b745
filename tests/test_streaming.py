"""Streams fed file by file end up where one batch over all rows does."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import models
from fieldgauge.operators.ordered import last_n_rows
from fieldgauge.plans import forecast
from fieldgauge.session import scratch_path
from fieldgauge.streaming import monitor, scoring

SCHEMA = ("event_id long, ts timestamp, device long, health double, torque int, "
          "temperature double")


@pytest.fixture(scope="module")
def readings(spark):
    r = random.Random(4)
    rows = [(i, 1_700_000_000 + 60 * i, 1 if i % 3 else r.randrange(2, 8),
             r.random() * 60 + 40, r.randrange(40, 63), 298 + r.randrange(43) / 10)
            for i in range(900)]
    return spark.createDataFrame(
        rows, "event_id long, t long, device long, health double, torque int, "
              "temperature double").select(
        "event_id", F.timestamp_seconds("t").alias("ts"), "device", "health", "torque",
        "temperature")


@pytest.fixture(scope="module")
def folder(spark, readings):
    path = scratch_path(spark, "readings")
    for k in range(4):  # in time order, one file each
        part = readings.filter((F.col("event_id") >= 225 * k) & (F.col("event_id") < 225 * (k + 1)))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return monitor.table_stream(spark, folder, "*.parquet", SCHEMA, files_per_trigger=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def updated(spark, query, keys):
    path = scratch_path(spark, "updates")
    monitor.run_update(query, path, scratch_path(spark, "cp"), keys)
    return monitor.read_latest(spark, path)


def test_alerts(spark, readings, folder):
    path = scratch_path(spark, "alerts")
    monitor.run_append(monitor.alerts(stream(spark, folder)), path, scratch_path(spark, "cp"))
    assert rows_of(spark.read.parquet(path)) == rows_of(monitor.alerts(readings))


def test_latest_and_steps(spark, readings, folder):
    newest = updated(spark, monitor.latest_reading(stream(spark, folder), "device",
                                                   ["ts", "event_id"]), ["device"])
    assert rows_of(newest) == rows_of(monitor.latest_reading(readings, "device",
                                                             ["ts", "event_id"]))
    steps = updated(spark, monitor.step_counter(stream(spark, folder), "device"), ["device"])
    assert rows_of(steps) == rows_of(monitor.step_counter(readings, "device"))


def test_buffer_over_several_batches(spark, readings, folder):
    got = updated(spark, monitor.buffer_stream(stream(spark, folder), "device",
                                               ["ts", "event_id"]), ["device"])
    want = last_n_rows(readings, ["device"], ["ts", "event_id"], monitor.BUFFER_ROWS)
    assert rows_of(got.select(*readings.columns)) == rows_of(want)


def test_buffer_state_is_kept_by_groups_of_devices(spark):
    """The state's entries, each a call to a Python worker, don't grow with the devices."""
    rows = spark.range(9000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
        (F.col("id") % 3000).alias("device"), F.lit(90.0).alias("health"),
        F.lit(40).alias("torque"), F.lit(299.0).alias("temperature"))
    folder = scratch_path(spark, "devices")
    for part in (rows.filter("event_id < 5000"), rows.filter("event_id >= 5000")):
        part.coalesce(1).write.mode("append").parquet(folder)
    order, checkpoint, path = ["ts", "event_id"], scratch_path(spark, "cp"), scratch_path(spark, "b")
    monitor.run_update(monitor.buffer_stream(stream(spark, folder), "device", order, n=2), path,
                       checkpoint, ["device"])
    assert rows_of(monitor.read_latest(spark, path).select(*rows.columns)) == rows_of(
        last_n_rows(rows, ["device"], order, 2))
    state = spark.read.format("statestore").option("stateVarName", "rows").load(checkpoint)
    assert 0 < state.count() <= 1024


def test_buffer_keeps_long_numbers_nulls_and_nameless_devices(spark):
    rows = [(2**60 + i if i % 4 else None, 60 * i, [1, None, 2][i % 3], float("nan") if i == 3
             else None if i % 5 == 0 else i / 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "event_id long, t long, device long, health double") \
        .select("event_id", F.timestamp_seconds("t").alias("ts"), "device", "health")
    folder = scratch_path(spark, "odd")
    for low in (0, 17):
        frame.filter((F.unix_timestamp("ts") >= 60 * low)
                     & ((F.unix_timestamp("ts") < 60 * 17) | (F.lit(low) > 0))) \
            .coalesce(1).write.mode("append").parquet(folder)
    source = monitor.table_stream(spark, folder, "*.parquet", frame.schema, files_per_trigger=1)
    for n in (5, 50):
        got = updated(spark, monitor.buffer_stream(source, "device", ["ts"], n=n), ["device"])
        assert repr(rows_of(got)) == repr(rows_of(last_n_rows(frame, ["device"], ["ts"], n)))


def test_idle_devices_are_forgotten():
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    held = Held()
    job = monitor._LastRows("device", ["ts"], 2, idle_ms=100)
    job.init(SimpleNamespace(getValueState=lambda *a, **k: held))

    def send(now, *rows):
        packed = [monitor._packed(pa.Table.from_pylist([dict(zip(("device", "ts"), r))]))
                  for r in rows]
        frames = job.handleInputRows((0,), iter([pd.DataFrame({monitor._PACKED: packed})]),
                                     SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now))
        return sorted((r["device"], r["ts"]) for f in frames for p in f[monitor._PACKED]
                      for r in monitor._unpacked(p).to_pylist())

    assert send(1000, (1, 1), (1, 2), (2, 3)) == [(1, 1), (1, 2), (2, 3)]
    assert send(1060, (1, 4)) == [(1, 2), (1, 4)]  # the other device has nothing new
    assert send(1120, (1, 5), (2, 6)) == [(1, 4), (1, 5), (2, 6)]  # 2 was idle for 120 ms
    assert send(1219, (2, 7)) == [(2, 6), (2, 7)]


@pytest.mark.parametrize("devices", [3, 10**6])
def test_rows_are_sorted_in_proportion(monkeypatch, devices):
    """A task's cut sorts each row a few times, however many devices there are."""
    seen, real = [], monitor._newest
    monkeypatch.setattr(monitor, "_newest", lambda rows, *a: (
        seen.append(rows.num_rows), real(rows, *a))[1])
    batches = [pa.RecordBatch.from_pydict({"device": [i % devices for i in range(a, a + 2000)],
                                           "ts": list(range(a, a + 2000))})
               for a in range(0, 400_000, 2000)]
    cut = list(monitor._cut(iter(batches), "device", ["ts"], 20))
    assert sum(seen) <= 3 * 400_000 and max(seen) <= monitor.CHUNK_ROWS + 2000
    assert sum(t.num_rows for t in cut) == min(400_000, 20 * devices)


@pytest.mark.parametrize("window", [{"length": "2 hours"},
                                    {"length": "2 hours", "slide": "30 minutes"}])
def test_closed_windows_equal_the_batch(spark, readings, folder, window):
    path = scratch_path(spark, "trend")
    monitor.run_append(monitor.trend_stream(stream(spark, folder), "torque", ["device"],
                                            **window), path, scratch_path(spark, "cp"))
    newest = readings.agg(F.max("ts")).first()[0]
    closed = monitor.trend(readings, "torque", ["device"], **window).filter(
        F.col("window_end") <= monitor.closed_before(F.lit(newest)))
    assert rows_of(spark.read.parquet(path)) == rows_of(closed)


def test_late_rows_stay_out_of_windows_but_raise_alerts(spark):
    folder = scratch_path(spark, "late")
    def write(rows):
        spark.createDataFrame(rows, "event_id long, t long, device long, health double, "
                              "torque int, temperature double").select(
            "event_id", F.timestamp_seconds("t").alias("ts"), "device", "health", "torque",
            "temperature").coalesce(1).write.mode("append").parquet(folder)
    write([(1, 0, 1, 90.0, 40, 299.0), (2, 40_000, 1, 90.0, 40, 299.0)])
    write([(5, 50_000, 1, 90.0, 40, 299.0)])
    write([(3, 100, 1, 10.0, 60, 299.0), (4, 80_000, 1, 90.0, 40, 299.0)])
    trend, alerts = scratch_path(spark, "t"), scratch_path(spark, "a")
    monitor.run_append(monitor.trend_stream(stream(spark, folder), "torque", ["device"],
                                            length="1 hour"), trend, scratch_path(spark, "cp"))
    monitor.run_append(monitor.alerts(stream(spark, folder)), alerts, scratch_path(spark, "cp"))
    first = spark.read.parquet(trend).orderBy("window_start").first()
    assert (first["n"], first["mean_value"]) == (1, 40.0)
    assert [r["event_id"] for r in spark.read.parquet(alerts).collect()] == [3]


def test_repeated_readings_are_dropped(spark, readings, folder):
    path = scratch_path(spark, "dedup")
    again = stream(spark, folder).withColumn("event_id", F.expr("event_id div 2"))
    monitor.run_append(monitor.distinct_readings(again, ["event_id"]), path,
                       scratch_path(spark, "cp"))
    ids = [r["event_id"] for r in spark.read.parquet(path).collect()]
    assert sorted(ids) == list(range(450))


def test_whole_monitor(spark, readings, folder):
    place = scratch_path(spark, "monitor")
    for running in monitor.start_monitor(stream(spark, folder), place, key="device",
                                         order=["ts", "event_id"],
                                         sensors=["torque"], length="2 hours"):
        running.awaitTermination()
    board = {r["device"]: r for r in monitor.board(spark, place, "device", ["torque"]).collect()}
    newest = {r["device"]: r for r in monitor.with_status(
        monitor.latest_reading(readings, "device", ["ts", "event_id"])).collect()}
    assert {d: (r["event_id"], r["status"]) for d, r in board.items()} == {
        d: (r["event_id"], r["status"]) for d, r in newest.items()}
    assert sum(r["steps"] for r in board.values()) == 900
    assert sum(r["failures"] + r["warnings"] for r in board.values()) == (
        monitor.alerts(readings).count())
    assert monitor.read_latest(spark, f"{place}/buffer").count() \
        == last_n_rows(readings, ["device"], ["ts", "event_id"]).count()
    hours = monitor.trend(readings, "torque", ["device"], length="2 hours")
    last = {r["device"]: r["mean_value"] for r in hours.orderBy("window_start").collect()}
    assert {d: r["trend_torque"] for d, r in board.items()} == last


def test_appending_to_a_buffer_equals_one_cut(spark, readings):
    order = ["ts", "event_id"]
    old, new = readings.filter("event_id < 500"), readings.filter("event_id >= 500")
    got = monitor.append_readings(last_n_rows(old, ["device"], order), new, "device", order)
    assert rows_of(got) == rows_of(last_n_rows(readings, ["device"], order))


# --- scoring ---------------------------------------------------------------

@pytest.fixture(scope="module")
def engines(spark):
    r = random.Random(8)
    rows = [(u, c, r.random() * 10, r.random()) for u in range(12)
            for c in range(1, 40 + (u == 3) * 200)]
    return spark.createDataFrame(rows, "unit int, cycle int, s_1 double, s_2 double")


@pytest.fixture(scope="module")
def model(spark, engines):
    table = forecast.training_table(engines, ["s_1", "s_2"], unit="unit", cycle="cycle", cap=60)
    return forecast.train_baseline(table, ["s_1", "s_2"], unit="unit", trees=5, depth=3)[0]


def job_for(spark, model):
    return scoring.ScoringJob(model, "1", scratch_path(spark, "score"), "unit", "cycle",
                              ("s_1", "s_2"))


def test_stream_scores_equal_batch_scores(spark, engines, model):
    folder = scratch_path(spark, "cycles")
    for low, high in ((0, 13), (13, 14), (14, 16), (16, 1000)):
        (engines.filter((F.col("cycle") > low) & (F.col("cycle") <= high)).coalesce(1)
         .write.mode("append").parquet(folder))
    job = job_for(spark, model)
    job.run(monitor.table_stream(spark, folder, "*.parquet", engines.schema,
                                 files_per_trigger=1))
    batch = forecast.service_response(model, engines, ["s_1", "s_2"], unit="unit",
                                      cycle="cycle", version="1")
    assert rows_of(job.latest_answers(spark)) == rows_of(batch)
    assert job.answers(spark).count() > batch.count()


def test_repeated_batch_and_old_cycles(spark, engines, model):
    job = job_for(spark, model)
    first, second = engines.filter("cycle <= 10"), engines.filter("cycle between 9 and 12")
    job.score_batch(first, 0)
    job.score_batch(second.unionByName(second), 1)
    once = rows_of(job.answers(spark))
    job.score_batch(second.unionByName(second), 1)  # a retry replaces its own answers
    assert rows_of(job.answers(spark)) == once
    want = forecast.service_response(model, engines.filter("cycle <= 12"), ["s_1", "s_2"],
                                     unit="unit", cycle="cycle", version="1")
    assert rows_of(job.latest_answers(spark)) == rows_of(want)


def test_bad_requests_are_reported(spark, model):
    job = job_for(spark, model)
    job.score_batch(spark.createDataFrame(
        [(1, 1, 0.5, 0.5), (1, 0, 0.5, 0.5), (2, 3, None, 0.5), (2, 4, 0.1, float("nan")),
         (None, 1, 0.5, 0.5)], "unit int, cycle int, s_1 double, s_2 double"), 0)
    assert sorted(r["error"] for r in job.rejects(spark).collect()) == [
        "cycle must be 1 or more", "s_1 is missing", "s_2 is missing"]
    assert {r["unit"] for r in job.answers(spark).collect()} == {1, None}


def test_model_info(model):
    info = scoring.model_info(model, "3")
    assert info["model_version"] == "3" and info["maxDepth"] == "3"


def test_every_request_is_answered_or_rejected(spark, engines, model):
    job = scoring.ScoringJob(model, "1", scratch_path(spark, "score"), "unit", "cycle",
                             ("s_1", "s_2"), request="request")
    schema = "request long, unit int, cycle int, s_1 double, s_2 double"
    first = [(1, None, 1, 0.5, 0.5), (2, None, 1, 0.7, 0.5), (3, 4, 1, 0.5, 0.5),
             (4, 4, 1, 9.5, 0.1), (5, 4, 2, 0.5, None)]
    second = [(6, None, 1, 0.5, 0.5), (7, 4, 1, 0.5, 0.5), (8, 4, 3, 0.4, 0.4)]
    for number, rows in enumerate((first, second)):
        job.score_batch(spark.createDataFrame(rows, schema), number)
    answered = {r["request"]: r["predicted_RUL"] for r in job.answers(spark).collect()}
    rejected = {r["request"]: r["error"] for r in job.rejects(spark).collect()}
    assert set(answered) == {1, 2, 4, 6, 8}
    assert rejected == {3: "cycle was sent again", 5: "s_2 is missing",
                        7: "cycle is not after the last one answered"}
    assert answered[1] == answered[6]  # anonymous requests share no history


def test_a_missing_sensor_is_answered(spark, engines, model):
    gap = engines.withColumn("s_1", F.when(F.col("unit") == 2, None).otherwise(F.col("s_1")))
    got = forecast.service_response(model, gap, ["s_1", "s_2"], unit="unit", cycle="cycle",
                                    version="1")
    assert got.count() == 12


def test_stored_model_answers_alike(spark, engines, model):
    path = scratch_path(spark, "model")
    models.save_model(model, path, "7", ["s_1"], {"trees": 5})
    loaded, card = models.load_model(spark, path)
    assert card == {"version": "7", "features": ["s_1"], "settings": {"trees": 5}}
    both = [forecast.service_response(m, engines, ["s_1", "s_2"], unit="unit", cycle="cycle",
                                      version="7") for m in (model, loaded)]
    assert rows_of(both[0]) == rows_of(both[1])


def test_scoring_passes_have_as_many_tasks_as_cores(spark, engines, model, monkeypatch):
    seen, real = [], scoring.rolling_features
    monkeypatch.setattr(scoring, "rolling_features", lambda rows, *a, **k: (
        seen.append(rows.rdd.getNumPartitions()), real(rows, *a, **k))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        job_for(spark, model).score_batch(engines, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen and max(seen) <= 2 * spark.sparkContext.defaultParallelism
