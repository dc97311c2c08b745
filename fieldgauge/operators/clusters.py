"""k-means from many starts at once: every step is one scan for all of them.

Fitting ten times reads the rows ten times per step. Here a row meets the centres of all starts
in the same task, and one aggregate adds up rows, coordinates and squared distances per (start,
centre). A task sends at most starts x k short rows; the driver holds the centres and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Clustering:
    """Centres of the best start, its cost (sum of squared distances) and those of all."""
    centres: list[list[float]]
    cost: float
    costs: list[float]
    scans: int


def _uniform(key: Column, salt: Column) -> Column:
    """A number in (0, 1) fixed by the key and the salt."""
    bits = F.shiftrightunsigned(F.xxhash64(key, salt), 11)
    return (bits.cast("double") + 0.5) / float(2 ** 53)


def _squared(columns: Sequence[str], centre: Sequence[Column]) -> Column:
    """Squared distance to a centre given by its coordinates."""
    parts = [F.col(c) - centre[i] for i, c in enumerate(columns)]
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def _with_starts(df: DataFrame, columns: Sequence[str],
                 centres: dict[int, list[list[float]]]) -> DataFrame:
    """Every row once per start, with the nearest of its centres and the squared distance.

    The starts are a literal: rows multiply inside the scan's task, nothing is joined.
    """
    listed = F.array(*[
        F.struct(F.lit(start).alias("start"),
                 F.lit([float(x) for c in points for x in c]).alias("flat"))
        for start, points in sorted(centres.items())])
    size, width = len(next(iter(centres.values()))), len(columns)
    rows = df.select("*", F.inline(listed))
    nearest = F.least(*[
        F.struct(_squared(columns, [F.col("flat")[j * width + i] for i in range(width)])
                 .alias("distance"), F.lit(j).alias("centre")) for j in range(size)]
    ) if size > 1 else F.struct(
        _squared(columns, [F.col("flat")[i] for i in range(width)]).alias("distance"),
        F.lit(0).alias("centre"))
    return rows.withColumn("nearest", nearest).drop("flat")


def _starting_centres(df: DataFrame, columns: Sequence[str], key: Column, k: int,
                      starts: int, seed: int) -> dict[int, list[list[float]]]:
    """k-means++ for all starts, one scan per centre.

    A row is drawn with a chance in proportion to its squared distance: the row of least
    ``-log(u) / distance`` is such a draw, and a minimum needs no total first. Ties of the draw
    go to the smaller coordinates. With fewer distinct rows than ``k`` some centres are equal.
    """
    centres: dict[int, list[list[float]]] = {}
    point = F.array(*columns)
    for step in range(k):
        if step == 0:
            rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))
                             .alias("start"))
            weight = F.lit(1.0)
        else:
            rows = _with_starts(df, columns, centres)
            weight = F.col("nearest.distance")
        salt = F.concat_ws("|", F.lit(str(seed)), F.col("start").cast("string"),
                           F.lit(str(step)))
        draw = F.when(weight > 0, -F.log(_uniform(key, salt)) / weight).otherwise(math.inf)
        drawn = rows.groupBy("start").agg(
            F.min(F.struct(draw.alias("draw"), point.alias("point"))).alias("m")).collect()
        if not drawn:
            raise ValueError("k-means needs at least one row")
        for r in drawn:
            centres.setdefault(r["start"], []).append(list(r["m"]["point"]))
    return centres


def kmeans_restarts(df: DataFrame, columns: Sequence[str], *, key: Column, k: int, restarts: int,
                    seed: int, max_iter: int = 300, tol: float = 1e-4) -> Clustering:
    """The best of ``restarts`` k-means fits; all of them move one step per scan of ``df``.

    ``df`` holds double columns without NULLs and should be persisted. ``key`` tells rows apart in
    the draws; rows of equal key and coordinates are drawn as one, but all of them count
    afterwards. A start is done when no centre moves by more than ``tol``; a centre without rows
    stays. An empty table has no clustering and raises ``ValueError``. The lowest cost wins, the
    first start on a tie.
    """
    rows = df.select(*columns, key.alias("__key"))
    centres = _starting_centres(rows, columns, F.col("__key"), k, restarts, seed)
    moving, costs, scans = set(centres), {}, k
    narrow = df.select(*columns)
    for step in range(max_iter + 1):
        active = {s: centres[s] for s in sorted(moving)}
        sums = (_with_starts(narrow, columns, active)
                .groupBy("start", F.col("nearest.centre").alias("centre"))
                .agg(F.sum("nearest.distance").alias("cost"), F.count(F.lit(1)).alias("n"),
                     *[F.sum(c).alias(f"sum_{i}") for i, c in enumerate(columns)]).collect())
        scans += 1
        found = {(r["start"], r["centre"]): r for r in sums}
        for s, points in active.items():
            # The cost belongs to the centres that this scan used.
            costs[s] = math.fsum(r["cost"] for (start, _), r in found.items() if start == s)
            new = []
            for j, old in enumerate(points):
                r = found.get((s, j))
                new.append(old if r is None else
                           [r[f"sum_{i}"] / r["n"] for i in range(len(columns))])
            if step == max_iter or all(
                    math.dist(a, b) <= tol for a, b in zip(points, new, strict=True)):
                moving.discard(s)
            else:
                centres[s] = new
        if not moving:
            break
    best = min(sorted(costs), key=costs.__getitem__)
    return Clustering(centres[best], costs[best], [costs[s] for s in sorted(costs)], scans)


def assigned(df: DataFrame, columns: Sequence[str], clustering: Clustering, out: str) -> DataFrame:
    """Add the number of the nearest centre; NULL where a coordinate is NULL."""
    one = _with_starts(df.select("*"), columns, {0: clustering.centres})
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return one.withColumn(out, F.when(known, F.col("nearest.centre"))).drop("start", "nearest")
