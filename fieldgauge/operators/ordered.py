"""Ordered per-entity operators that stay parallel when one entity holds most rows.

A plain window puts all rows of an entity in one task. That is the right plan for entities up
to ``split_rows`` rows. The rows of larger ones are set apart and range-partitioned by (entity,
order); their chunk numbers are fixed by a checkpoint, and the windows run inside chunks with
small carry-over tables between them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.session import shared_dir

SPLIT_ROWS = 5_000_000
BROADCAST_ROWS = 1_000_000
BLOCK_ROWS = 1_000_000
_CHUNK, _HOME, _POSITION = "__chunk", "__home", "__position"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group; reads the key columns only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Fix an aggregate's rows, count them, and mark it for broadcast when they are few.

    Left to itself, an adaptive join learns the size only after it has shuffled the large side.
    """
    shared_dir(df.sparkSession)
    fixed = df.checkpoint()
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed


def split_off_hot(df: DataFrame, keys: Sequence[str],
                  split_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of normal groups and those of groups above ``split_rows``; None for no rows.

    There are at most (rows / split_rows) hot keys, so the two sides part without a shuffle.
    """
    if largest_group(df, keys) <= split_rows:
        return df, None
    if not keys:
        return None, df
    large = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
             .filter(F.col("__n") > split_rows))
    hot = broadcast_if_small(large.select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def _range_chunks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows spread evenly over ordered chunks, whose numbers no retry can change."""
    shared_dir(df.sparkSession)
    return (df.repartitionByRange(*columns)
            .withColumn(_CHUNK, F.spark_partition_id())
            .checkpoint())


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   totals: Mapping[str, Column], *, split: bool) -> DataFrame:
    """Add inclusive running sums per key in the given order.

    ``order`` must be a total order inside a key, or equal rows get an arbitrary order.
    """
    keys, order = list(keys), list(order)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not split:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({name: F.sum(c).over(w) for name, c in totals.items()})

    chunks = _range_chunks(df, keys + order)
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(*upto)
    rows = chunks.withColumns({name: F.sum(c).over(inside) for name, c in totals.items()})

    # One row per (entity, chunk): few rows even for an entity that spans every chunk.
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (chunks.groupBy(*keys, _CHUNK)
               .agg(*[F.sum(c).alias(name) for name, c in totals.items()])
               .withColumns({name: F.sum(name).over(before) for name in totals}))
    carried = carried.select(*[F.col(c).alias(f"__c_{c}") for c in [*keys, _CHUNK, *totals]])
    same = [F.col(c).eqNullSafe(F.col(f"__c_{c}")) for c in [*keys, _CHUNK]]
    return (rows.join(carried, same, "left")
            .withColumns({name: F.col(name) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))
                          for name in totals})
            .select(*df.columns, *totals))


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 out: str = "position", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Number the rows of every entity 1, 2, 3, … in the given order."""
    normal, hot = split_off_hot(df, keys, split_rows)
    parts = []
    if normal is not None:
        w = Window.partitionBy(*keys).orderBy(*order)
        parts.append(normal.withColumn(out, F.row_number().over(w).cast("long")))
    if hot is not None:
        parts.append(running_totals(hot, keys, order, {out: F.lit(1).cast("long")}, split=True))
    return reduce(DataFrame.unionByName, parts)


def _mean(value: Column, window) -> Column:
    # Sum and count apart, so that decimal inputs are summed exactly.
    return F.try_divide(F.sum(value).over(window).cast("double"),
                        F.count(value).over(window).cast("double"))


def without_nan(df: DataFrame, column: str) -> Column:
    """The column with NaN as NULL; other types than floating ones have no NaN."""
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.when(~F.isnan(column), F.col(column))
    return F.col(column)


def trailing_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  columns: Sequence[str], *, rows: int = 5, suffix: str = "_roll_mean",
                  split_rows: int = SPLIT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the current and up to ``rows - 1`` earlier rows, for every column.

    NULL and NaN are left out of sums and counts; without any value the mean is NULL.
    All columns share one window, hence one sort. An entity above ``split_rows`` is cut
    into blocks by row position; each block borrows the last rows of the block before it.
    """
    if block_rows < rows:
        raise ValueError("block_rows must be at least rows")
    keys = list(keys)
    frame = (-(rows - 1), Window.currentRow)
    names = [f"{c}{suffix}" for c in columns]
    normal, hot = split_off_hot(df, keys, split_rows)
    parts = []
    if normal is not None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        parts.append(normal.withColumns(
            {f"{c}{suffix}": _mean(without_nan(df, c), w) for c in columns}))
    if hot is not None:
        located = running_totals(hot, keys, order, {_POSITION: F.lit(1).cast("long")},
                                 split=True)
        home = F.floor((F.col(_POSITION) - 1) / block_rows)
        ends_block = (F.col(_POSITION) - 1) % block_rows >= block_rows - (rows - 1)
        blocks = (located.withColumn(_HOME, home)
                  .withColumn(_CHUNK, F.explode(
                      F.when(ends_block, F.array(F.col(_HOME), F.col(_HOME) + 1))
                      .otherwise(F.array(F.col(_HOME))))))
        w = Window.partitionBy(*keys, _CHUNK).orderBy(_POSITION).rowsBetween(*frame)
        parts.append(blocks.withColumns({f"{c}{suffix}": _mean(without_nan(df, c), w)
                                          for c in columns})
                     .filter(F.col(_CHUNK) == F.col(_HOME)).select(*df.columns, *names))
    return reduce(DataFrame.unionByName, parts)


def with_group_max(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Add the group maximum to every row; NULL where a key is NULL.

    An aggregate joined back: it combines before its shuffle, so a hot group costs nothing,
    and with few groups the rows themselves are not shuffled at all.
    """
    top = df.groupBy(*keys).agg(F.max(column).alias(out))
    return (df.join(broadcast_if_small(top), list(keys), "left").select(*df.columns, out))


def last_n_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                n: int = 20) -> DataFrame:
    """The last ``n`` rows of every entity. Spark cuts each group to ``n`` before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (df.withColumn(_POSITION, F.row_number().over(w))
            .filter(F.col(_POSITION) <= n).drop(_POSITION))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key. NULL keys count as equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(_POSITION, F.row_number().over(w))
            .filter(F.col(_POSITION) == 1).drop(_POSITION))


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every entity, as an aggregate that combines before its shuffle."""
    latest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return latest.select("r.*")
