"""Tables merged batch by batch, and the ledger of late rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.session import scratch_path
from fieldgauge.streaming.current import CurrentTable
from fieldgauge.streaming.ledger import TrendLedger

SCHEMA = "k long, part string, v long"


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names
                  if not f.startswith((".", "_")))


def batches(n, seed=1):
    draw = random.Random(seed)
    return [[(draw.choice([None, *range(30)]), "a", 100 * b + i) for i in range(1)]
            + [(k, "a", 100 * b + k) for k in draw.sample(range(40), 9)] for b in range(n)]


def test_fifty_batches_keep_the_file_count(spark):
    table, want, counts = CurrentTable(scratch_path(spark, "current"), ["k"], 4), {}, []
    for number, rows in enumerate(batches(50)):
        rows = list({r[0]: r for r in rows}.values())
        table.merge(spark.createDataFrame(rows, SCHEMA), number)
        want |= {r[0]: r for r in rows}
        counts.append(len(files(table.path)))
    assert {tuple(r) for r in table.read(spark).collect()} == set(want.values())
    assert max(counts) <= 2 * 4 + 2 and counts[10] == counts[-1]
    assert table.low_water(spark) == 49


def test_a_batch_run_again(spark):
    table = CurrentTable(scratch_path(spark, "current"), ["k"], 2)
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in
              ([(1, "a", 1), (2, "a", 2)], [(2, "a", 20), (3, "a", 30)])]
    def add(rows):
        return rows.groupBy("k", "part").agg(F.sum("v").alias("v"))
    for number in (0, 0, 1, 1, 0, 1):  # retries count once; an old batch is left out
        table.merge(frames[number], number, combine=add)
        if number == 1:
            assert sorted(map(tuple, table.read(spark).collect())) == [
                (1, "a", 1), (2, "a", 22), (3, "a", 30)]


def test_groups_of_rows_and_empty_batches(spark):
    table = CurrentTable(scratch_path(spark, "current"), ["k"], 3)
    with pytest.raises(ValueError):
        table.read(spark)
    table.merge(spark.createDataFrame([], SCHEMA), 0)
    assert table.read(spark).count() == 0
    table.merge(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], SCHEMA), 1)
    table.merge(spark.createDataFrame([(1, "c", 9)], SCHEMA), 2)
    table.merge(spark.createDataFrame([], SCHEMA), 3)
    assert sorted(map(tuple, table.read(spark).collect())) == [(1, "c", 9), (2, "a", 3)]


def test_ledger_counts_every_row_once(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([None, *range(0, 400_000, 777)]) if i % 9 == 0 else i * 300,
             draw.choice("ab"), draw.randrange(50)) for i in range(1200)]
    frame = spark.createDataFrame(rows, "i long, t long, g string, v long").select(
        "i", F.timestamp_seconds("t").alias("ts"), "g", "v")
    job = TrendLedger(scratch_path(spark, "ledger"), "v", ["g"], length="6 hours",
                      delay="30 minutes", buckets=3)
    newest, late, counted = None, set(), {}
    for number in range(6):
        part = frame.where(f"i >= {number * 200} AND i < {number * 200 + 200}")
        for _ in range(2 if number in (2, 3) else 1):
            job.process(part, number)
        for i, t, g, v in rows[number * 200:number * 200 + 200]:
            if t is None or (newest is not None and t < newest - 1800):
                late.add(i)
            else:
                key = (t // 21600 * 21600, g)
                n, total = counted.get(key, (0, 0))
                counted[key] = n + 1, total + v
        newest = max([t for _, t, _, _ in rows[:number * 200 + 200] if t is not None])
    assert late and {r.i for r in job.late(spark).collect()} == late
    found = {(int(r.s), r.g): (r.n, r.mean_value) for r in job.trend(spark).withColumn(
        "s", F.unix_timestamp("window_start")).collect()}
    assert found == {k: (n, total / n) for k, (n, total) in counted.items()}
    job.process(frame.limit(5), 1)  # an old batch changes nothing
    assert sum(r.rows for r in job.trend(spark).collect()) + len(late) == 1200


def test_only_the_buckets_of_a_batch_are_read(spark):
    """The rows read for a batch of one key don't grow with the number of keys."""
    read = []
    for n in (400, 4000):
        table = CurrentTable(scratch_path(spark, "current"), ["k"], n // 20)
        table.merge(spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("part"),
                                          F.col("id").alias("v")), 0)
        one = spark.createDataFrame([(7, "a", 0)], SCHEMA)
        assert [tuple(r) for r in table.rows_of(one, 1).collect()] == [(7, "a", 7)]
        before = set(files(f"{table.path}/data"))
        table.merge(one, 1)
        fresh = [f for f in files(f"{table.path}/data") if f not in before]
        read.append(spark.read.parquet(*fresh).count())
        assert table.read(spark).count() == n
        assert table.rows_of(spark.createDataFrame([(-1, "a", 0)], SCHEMA), 2) is None or \
            table.rows_of(spark.createDataFrame([(-1, "a", 0)], SCHEMA), 2).isEmpty()
    assert max(read) < 60
