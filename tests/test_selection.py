import random

import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import models, selection


def expected(rows, share):
    """The plain rule: per stratum, the first rounded share of the keys by (hash, key)."""
    out = set()
    for s in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == s)
        wanted = int(len(mine) * share + 0.5)
        out |= {key for _, key in mine[:wanted]}
    return out


def chosen(df, share):
    got = selection.first_by_hash(df, "key", "kind", F.col("h"), share, out="first")
    return {r["key"] for r in got.filter("first").collect()}, got


@pytest.mark.parametrize("share", [0.0, 0.01, 0.25, 0.5, 1.0])
def test_equals_a_sorted_list(spark, share):
    r = random.Random(5)
    rows = [(i, r.choice("aab"), r.randrange(2 ** 32)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, kind string, h long").repartition(6)
    assert chosen(df, share)[0] == expected(rows, share)


def test_equal_hashes_are_cut_by_key(spark):
    rows = [(i, "a", 77) for i in range(40)] + [(100 + i, "a", 2 ** 32 - 1) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, kind string, h long")
    for share in (0.3, 0.5, 0.8):
        assert chosen(df, share)[0] == expected(rows, share)


def test_null_strata_and_keys_repeats_and_clashing_names(spark):
    rows = [(None, None, 9, 1), (1, None, 9, 2), (2, None, 10, 3), (3, None, 11, 4),
            (7, "b", 5, 5), (7, "b", 5, 6), (8, "b", 6, 7), (9, "b", 7, 8)]
    df = spark.createDataFrame(rows, "key long, kind string, h long, n long")
    got = selection.first_by_hash(df, "key", "kind", F.col("h"), 0.25, out="first").collect()
    assert got[0].asDict().keys() == {"key", "kind", "h", "n", "first"} and len(got) == 8
    # Both rows of key 7 go where its first row goes.
    assert sorted(r["n"] for r in got if r["first"]) == [1, 5, 6]


def test_empty(spark):
    df = spark.createDataFrame([], "key long, kind string, h long")
    assert chosen(df, 0.5)[1].count() == 0


def test_the_plan_sorts_and_ranks_nothing(spark):
    df = spark.range(1000).withColumn("kind", F.col("id") % 3)
    split = models.stratified_split(df, "id", "kind", exact=True)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan and "CartesianProduct" not in plan


def test_selection_equals_ranking(spark):
    df = spark.range(2000).withColumn("kind", F.col("id") % 4)

    def ids(**kw):
        return {r["id"] for r in models.stratified_split(df, "id", "kind", exact=True, **kw)
                .filter("is_test").collect()}
    assert ids() == ids(split_rows=100) == ids(split_rows=10 ** 6)
