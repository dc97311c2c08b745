"""Exact largest inner products by norm buckets.

Vectors are dealt into buckets by length, longest first. A seed bucket gives every query a
first threshold. In each other bucket the threshold over both lengths is a cosine that every
result must reach there: above 1 the bucket is skipped; when it is high, candidates must lie in
a narrow range of the query's largest coordinates; when it is low, only the bucket's longest
vectors are looked at. What survives is verified by its product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.llm.common import stored

#: Local cosine from which coordinates prune better than lengths, and coordinates looked at.
STEEP = 0.6
FOCUS = 4


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """id and v: floor(factor * x) of every component x, as whole doubles. Rows with a NULL id,
    a NULL vector, or a NULL or non-finite component take no part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(e * factor).cast("double")).alias("v"))


def _matrix(column, wide: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lengths), max(wide, 1)))
    out[np.repeat(np.arange(len(lengths)), lengths),
        np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products as whole numbers: in doubles while these are exact, else in Python integers,
    held to the range of a long."""
    most = (np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)
            * queries.shape[1])
    if most < 2 ** 53:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(vectors).T, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, smaller ids first among equals."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


class Bucket:
    """Vectors sorted by length, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.units = self.vectors / np.maximum(self.norms, 1e-300)[:, None]

    def candidates(self, query: np.ndarray, threshold: float) -> np.ndarray:
        """Places that may hold a product of at least ``threshold``."""
        everything = np.arange(len(self.ids))
        length = math.sqrt(float(query @ query))
        if not math.isfinite(threshold) or threshold <= 0 or length == 0:
            return everything if threshold <= 0 or not math.isfinite(threshold) \
                else everything[:0]
        slack = 1 - 1e-9
        # Length pruning: |q| |p| >= threshold.
        long_enough = int(np.searchsorted(-self.norms, -threshold / length * slack,
                                          side="right"))
        if long_enough == 0:
            return everything[:0]
        local = threshold / (length * self.norms[0]) * slack
        if local < STEEP:
            return everything[:long_enough]
        # Coordinate pruning: a unit p with a cosine of c or more to a unit q lies, in each
        # coordinate, within q_i * c -+ sqrt((1 - c^2) (1 - q_i^2)); beyond q_i >= c there is
        # no upper end, below q_i <= -c no lower one.
        unit, c = query / length, min(local, 1.0)
        left = everything[:long_enough]
        for i in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            reach = math.sqrt(max((1 - c * c) * (1 - unit[i] ** 2), 0.0)) + 1e-9
            p = self.units[left, i]
            if unit[i] < c:
                left = left[p <= unit[i] * c + reach]
                p = self.units[left, i]
            if unit[i] > -c:
                left = left[p >= unit[i] * c - reach]
        return left


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, bucket_rows: int = 4096,
                 query_rows: int = 1024) -> DataFrame:
    """The k largest products of every query with the other vectors, ties to smaller ids.

    ``vectors`` has id and v (whole doubles). Returns query_id, rank, id, score; fewer than k
    rows only if there are fewer candidates. Vectors of unequal length count as filled with
    zeros. If an id stands on several rows, each is a candidate of the other ids' queries and
    the smallest of its vectors is its query. An empty table gives no rows.

    Buckets and query blocks have bounded sizes; each pair of them is one unit of work, and a
    unit gives at most k rows per query. No side is broadcast.
    """
    rows = stored(vectors.withColumn("norm", F.aggregate(
        "v", F.lit(0.0), lambda a, e: a + e * e)), "topk-vectors")
    n, wide = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id",
                           F.col("id").alias("score")).limit(0)
    parts = -(-n // bucket_rows)
    # Longest first; the id splits a run of equal lengths.
    dealt = stored(rows.repartitionByRange(parts, F.col("norm").desc(), F.col("id"))
                   .select("id", "v", F.spark_partition_id().alias("bucket")), "topk-buckets")
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    blocks = -(-max(asked.count(), 1) // query_rows)
    asked = stored(asked.withColumn(
        "block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "topk-queries")
    result = "query_id long, id long, score long"

    def work(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            def full(frame: pd.DataFrame) -> np.ndarray:
                return _matrix(pa.array(frame["v"].tolist(), pa.list_(pa.float64())), wide)
            bucket = Bucket(candidates["id"].to_numpy(), full(candidates))
            wanted = full(queries)
            limits = queries["threshold"].to_numpy(float)
            open_ = np.isnan(limits)
            # Without a threshold the whole bucket is verified at once.
            whole = _exact(wanted[open_], bucket.vectors) if open_.any() else None
            seen = 0
            for row, query_id in enumerate(queries["id"].to_numpy()):
                if open_[row]:
                    place, scores = np.arange(len(bucket.ids)), whole[seen]
                    seen += 1
                else:
                    place = bucket.candidates(wanted[row], limits[row])
                    scores = _exact(wanted[row:row + 1], bucket.vectors[place])[0]
                other = bucket.ids[place] != query_id
                if not open_[row]:
                    other &= scores >= limits[row]
                place, scores = place[other], scores[other]
                best = _best(bucket.ids[place], scores, k)
                out.append(pd.DataFrame({"query_id": query_id, "id": bucket.ids[place[best]],
                                         "score": scores[best]}))
        if not out:
            return pd.DataFrame({c: pd.Series(dtype="int64")
                                 for c in ("query_id", "id", "score")})
        return pd.concat(out, ignore_index=True)

    def verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
        """pairs: queries with the bucket they go to; grouped with that bucket's vectors."""
        units = pairs.select(F.col("bucket").alias("bucket"),
                             F.col("block").alias("block")).distinct()
        spread = candidates.join(units, "bucket").select("bucket", "block", "id", "v")
        return spread.groupBy("bucket", "block").cogroup(
            pairs.groupBy("bucket", "block")).applyInPandas(work, result)

    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    # The seed: the bucket of the longest vectors.
    seed, last = dealt.agg(F.min("bucket"), F.max("bucket")).first()
    first = asked.withColumn("bucket", F.lit(seed)) \
        .withColumn("threshold", F.lit(None).cast("double"))
    found = stored(verified(first, dealt.where(F.col("bucket") == seed)), "topk-seeds")
    limits = found.groupBy(F.col("query_id").alias("of")).agg(
        F.min("score").cast("double").alias("threshold"), F.count(F.lit(1)).alias("n"))
    limited = asked.join(limits, asked["id"] == limits["of"], "left").select(
        "id", "v", "block", F.when(F.col("n") >= k, F.col("threshold")).alias("threshold"))
    more = found.limit(0)
    if last > seed:
        rest = dealt.where(F.col("bucket") != seed)
        square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
        longest = rest.groupBy("bucket").agg(F.max(F.sqrt(square)).alias("longest"))
        # Each query goes to the buckets in which its threshold can be reached.
        sent = (
            limited.withColumn("length", F.sqrt(square))
            .withColumn("bucket", F.explode(F.sequence(F.lit(seed + 1), F.lit(last))))
            .join(longest, "bucket")
            .where(F.col("threshold").isNull()
                   | (F.col("length") * F.col("longest") * (1 + 1e-9) >= F.col("threshold")))
            .select("id", "v", "block", "threshold", "bucket")
        )
        more = verified(stored(sent, "topk-sent"), rest)
    return (
        found.unionByName(more)
        .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    )
