"""The first n rows of every stratum by a hash, found by counting digits instead of sorting.

Each round counts the rows per stratum and digit of their hash and keeps only the digit in which
the n-th row lies. Three rounds fix a hash of 32 bits. A round moves at most 2,048 counts per
stratum and task, whatever the rows; nothing is sorted and no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.operators.ordered import broadcast_if_small

HASH_BITS = 32
DIGITS = (11, 11, 10)  # bits of a round, from the top


def _cut(counts: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """Per stratum the value in which row number ``left`` lies, and what is left inside it.

    ``counts`` holds (stratum, value, n). A stratum that wants nothing, or more than there is,
    has no cut value.
    """
    listed = counts.groupBy("__stratum").agg(
        F.array_sort(F.collect_list(F.struct(value, "n"))).alias("steps"))
    found = F.aggregate(
        "steps", F.struct(F.col("left").alias("left"), F.lit(None).cast(
            dict(counts.dtypes)[value]).alias("at")),
        lambda state, step: F.when(state["at"].isNotNull(), state)
        .when(step["n"] < state["left"], F.struct((state["left"] - step["n"]).alias("left"),
                                                  state["at"].alias("at")))
        .otherwise(F.struct(state["left"].alias("left"), step[value].alias("at"))))
    return (wanted.join(listed, wanted["__stratum"].eqNullSafe(listed["__stratum"]), "left")
            .drop(listed["__stratum"]).withColumn("found", found)
            .select(*[c for c in wanted.columns if c != "left"], F.col("found.left").alias("left"),
                    F.col("found.at").alias(value)))


def first_by_hash(df: DataFrame, key: str, stratum: str, hashed: Column, share: float, *,
                  out: str) -> DataFrame:
    """Add ``out``: whether a row is among the first ``round(share * rows)`` of its stratum in
    the order of (``hashed``, ``key``).

    ``hashed`` is a whole number below 2^32, the same for equal keys. ``key`` names a row; repeated
    rows of a key all go where its first one goes, so a key is never on both sides. NULL strata
    form a stratum, NULL keys come first among equal hashes. An empty table stays empty.
    """
    rows = df.withColumn("__hash", hashed.cast("long"))
    narrow = rows.select(F.col(stratum).alias("__stratum"), F.col(key).alias("__key"), "__hash")
    sizes = narrow.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n"))
    cuts = sizes.select("__stratum", F.round(F.col("n") * share).cast("long").alias("left"),
                        F.lit(0).cast("long").alias("prefix")).filter("left > 0")
    cuts, shift = broadcast_if_small(cuts), HASH_BITS

    def inside(cuts):
        """The rows whose hash begins with the stratum's prefix."""
        near = cuts.select(F.col("__stratum").alias("__s"), "prefix")
        same = F.col("__stratum").eqNullSafe(F.col("__s"))
        top = F.expr(f"shiftright(__hash, {shift})")
        return narrow.join(near, same & (top == F.col("prefix"))).drop("__s", "prefix")

    for bits in DIGITS:
        within = inside(cuts)
        shift -= bits
        digit = F.expr(f"shiftright(__hash, {shift}) & {2 ** bits - 1}")
        counts = within.groupBy("__stratum", digit.alias("digit")).agg(
            F.count(F.lit(1)).alias("n"))
        cuts = broadcast_if_small(
            _cut(counts, cuts, "digit")
            .withColumn("prefix", F.col("prefix") * 2 ** bits + F.col("digit")).drop("digit"))
    # Keys of one hash: a 2^32nd of a stratum's keys, two or three of them in ten thousand million.
    tied = inside(cuts).groupBy("__stratum", F.struct("__key").alias("last")).agg(
        F.count(F.lit(1)).alias("n"))
    cuts = broadcast_if_small(_cut(tied, cuts, "last").select(
        F.col("__stratum").alias("__s"), F.col("prefix").alias("__cut"),
        F.col("last").alias("__last")))
    at_cut = (F.col("__hash") == F.col("__cut")) & (F.struct(F.col(key)) <= F.col("__last"))
    chosen = F.coalesce((F.col("__hash") < F.col("__cut")) | at_cut, F.lit(False))
    return (rows.join(cuts, F.col(stratum).eqNullSafe(F.col("__s")), "left")
            .withColumn(out, chosen).drop("__hash", "__s", "__cut", "__last"))
