import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import sketches


@pytest.fixture(scope="module")
def visits(spark):
    return spark.range(60000).select(
        F.format_string("2024-%02d", F.col("id") % 6 + 1).alias("month"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.expr("id div 7 % 3")).alias("kind"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(9000))).alias("who"))


def test_merged_sketches_stay_within_the_bound(spark, visits, tmp_path):
    path = str(tmp_path / "s")
    sketches.store(sketches.distinct_sketches(visits, "who", ["month", "kind"]), path, "month")
    stored = sketches.load(spark, path, "month")
    assert stored.count() == 24
    for by in (["month"], ["kind"], []):
        exact = visits.groupBy(*by).agg(F.count_distinct("who").alias("n"),
                                        F.count("*").alias("all"))
        guess = sketches.estimated(sketches.merged(stored, by))
        want = {tuple(r[c] for c in by): (r["n"], r["all"]) for r in exact.collect()}
        got = {tuple(r[c] for c in by): (r["distinct"], r["rows"]) for r in guess.collect()}
        assert want.keys() == got.keys()
        for k, (n, rows) in want.items():
            assert got[k][1] == rows
            assert abs(got[k][0] - n) <= 4 * sketches.standard_error() * n + 1


def test_a_month_written_again_replaces_itself_only(spark, visits, tmp_path):
    path = str(tmp_path / "s")
    made = sketches.distinct_sketches(visits, "who", ["month", "kind"])
    sketches.store(made, path, "month")
    before = sketches.estimated(sketches.merged(sketches.load(spark, path, "month"), [])).first()
    sketches.store(made.filter("month = '2024-03'"), path, "month")
    after = sketches.estimated(sketches.merged(sketches.load(spark, path, "month"), [])).first()
    assert before == after
    more = visits.filter("month = '2024-03'").withColumn("who", F.col("who") + 100000)
    sketches.store(sketches.distinct_sketches(more, "who", ["month", "kind"]), path, "month")
    stored = sketches.load(spark, path, "month")
    assert stored.count() == 24
    assert sketches.estimated(sketches.merged(stored, [])).first()["distinct"] > 8500 + 4000


def test_merging_does_not_depend_on_the_partitions(visits):
    def one(df):
        made = sketches.distinct_sketches(df, "who", ["month", "kind"])
        return sketches.estimated(sketches.merged(made, [])).first()["distinct"]
    assert one(visits.repartition(3)) == one(visits.repartition(17))


def test_no_rows(spark, visits):
    made = sketches.distinct_sketches(visits.limit(0), "who", ["month"])
    assert sketches.estimated(made).collect() == []
