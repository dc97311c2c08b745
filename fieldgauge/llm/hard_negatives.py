"""Hard negatives by exact products over a residue number system.

Vectors of whole numbers are reduced modulo a few small primes. Residues lie around zero, so a
float32 matrix product of ``CHUNK`` of them is exact; the products are put together by the
Chinese remainder theorem (mixed radix digits), signed, and exact at any size.

Anchors and candidates are dealt into blocks of bounded size, and each pair of blocks is a unit
of work. First every anchor meets the blocks of its own label and keeps its best rows, the
positives; then it meets all blocks, and each positive opens a window of scores from which the
best rows of other labels are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fieldgauge.llm.common import stored

#: Coordinates multiplied at a time; half a prime squared, so many times, stays below 2**24.
CHUNK = 64
_LARGEST = 1021
#: Scores are held to the range of a long.
_RANGE = 2 ** 63


def primes(bound: int) -> list[int]:
    """Primes from the largest usable one down whose product exceeds 2 * bound."""
    found, product, p = [], 1, _LARGEST
    while product <= 2 * bound:
        if p < 3:
            raise ValueError("the vectors are too large for this residue system")
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p around zero, as float32; fmod is exact for doubles of any size."""
    r = np.fmod(x, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from 0 to p - 1."""
    total = np.zeros((len(a), len(b)), np.float32)
    ra, rb = _residues(a, p), _residues(b, p)
    for first in range(0, a.shape[1], CHUNK):
        part = ra[:, first:first + CHUNK] @ rb[:, first:first + CHUNK].T
        total += part - np.float32(p) * np.rint(part / np.float32(p))
    return np.mod(total.astype(np.int64), p)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of rows of a and b (whole doubles) as exact integers in longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    with np.errstate(over="ignore"):
        norms = [math.sqrt(float((x * x).sum(1).max())) for x in (a, b)]
    if math.isfinite(norms[0] * norms[1]):
        bound = min(bound, int(norms[0] * norms[1] * (1 + 1e-9)) + 1)
    moduli = primes(bound)
    whole = math.prod(moduli)
    narrow = whole < 2 ** 62
    # Mixed radix: x = d0 + d1 p0 + d2 p0 p1 + ..., each digit from the residue of its prime.
    value = np.zeros((len(a), len(b)), np.int64 if narrow else object)
    base, digits = 1, []
    for i, p in enumerate(moduli):
        r = _product(a, b, p)
        radix = 1
        for q, d in zip(moduli, digits):
            r = (r - d * (radix % p)) % p
            radix *= q
        digit = r * pow(radix, -1, p) % p
        digits.append(digit)
        value = value + (digit if narrow else digit.astype(object)) * base
        base *= p
    value = np.where(value > whole // 2, value - whole, value)
    if narrow:
        return value
    return np.clip(value, -_RANGE, _RANGE - 1).astype(np.int64)


def window(positive: int) -> tuple[int, int]:
    """The scores s with 80 * positive <= 100 * s <= 100 * positive."""
    return positive - positive // 5, positive


def first_in_window(ids: np.ndarray, scores: np.ndarray, low: int, high: int, k: int
                    ) -> slice:
    """Of scores in falling order, the first k places within the window."""
    first = int(np.searchsorted(-scores, -high, side="left")) if high > -_RANGE else len(scores)
    last = int(np.searchsorted(-scores, -low, side="right")) if low <= high else first
    return slice(first, max(first, min(last, first + k)))


def _matrix(column: pd.Series, wide: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(column), max(wide, 1)))
    for row, v in enumerate(column):
        out[row, :len(v)] = v
    return out


def labelled(vectors: DataFrame, id_col: str, label_col: str, vector_col: str,
             factor: float) -> DataFrame:
    """id, label and v: floor(factor * x) of every component x, as whole doubles. Rows with a
    NULL id, label or vector, or with a NULL or non-finite component, take no part."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
                         & x.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        # From 2**52 on a double is whole already, and may be too large for a long.
        F.transform(x, lambda e: F.when(F.abs(e * factor) < 2.0 ** 52, F.floor(e * factor)
                                        .cast("double")).otherwise(e * factor)).alias("v"))


_PAIR = ["anchor_id", "place", "positive_id", "positive_score", "id", "score"]
_NONE = pd.DataFrame({c: pd.Series(dtype="int64") for c in _PAIR})


def hard_negatives(vectors: DataFrame, is_anchor, k: int = 5, positives: int = 5,
                   block_rows: int = 8192, anchor_rows: int = 512) -> DataFrame:
    """vectors: id, label, v (whole doubles). Per anchor and positive the first ``k`` rows of
    another label whose score is 80 % to 100 % of the positive's.

    A row's score is its product with the anchor; the order is by score, ties by id. An anchor's
    positives are its first ``positives`` other rows of the same label. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score. If an id stands on
    several rows, each is a candidate of the anchors of other ids, and the least (label, vector)
    is its anchor. Vectors of unequal length count as filled with zeros. A positive with a
    negative score has no window. An empty table, or one of a single label, gives no rows.

    ``block_rows`` and ``anchor_rows`` bound a unit's two sides; nothing is broadcast or drawn to
    the driver, and a label with most of the rows has as many blocks as it needs.
    """
    rows = stored(vectors.select("id", "label", "v"), "negatives-vectors")
    n, wide = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    anchors = stored(rows.where(is_anchor).groupBy("id").agg(
        F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v"),
        "negatives-anchors")
    n_anchors = anchors.count()
    wide = max(wide or 0, 0)

    def blocks_of(count, size: int):
        return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("int")

    def dealt(frame: DataFrame, own: str, other: str, blocks, others) -> DataFrame:
        """Each row in one of its side's blocks, against every block of the other side."""
        return frame.withColumn(
            own, F.pmod(F.xxhash64("id", F.lit(own)), blocks).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), others - 1)))

    def units(askers: DataFrame, candidates: DataFrame, by: list[str], work) -> DataFrame:
        """work(candidates, anchors) on every pair of blocks."""
        keys = [*by, "a", "c"]
        return candidates.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(
            work, "anchor_id long, place long, positive_id long, positive_score long, id long, "
            "score long")

    def best_of_label(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(asked):
            return _NONE
        scores = exact_scores(_matrix(asked["v"], wide), _matrix(candidates["v"], wide))
        ids, out = candidates["id"].to_numpy(), []
        for row, anchor in enumerate(asked["id"].to_numpy()):
            place = np.flatnonzero(ids != anchor)
            if len(place) > positives:
                of = scores[row, place]
                cut = np.partition(of, len(of) - positives)[len(of) - positives]
                place = place[of >= cut]
            place = place[np.lexsort((ids[place], -scores[row, place]))[:positives]]
            out.append(pd.DataFrame({"anchor_id": anchor, "place": 0, "positive_id": 0,
                                     "positive_score": 0, "id": ids[place],
                                     "score": scores[row, place]}))
        return pd.concat(out, ignore_index=True)

    def in_windows(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(asked):
            return _NONE
        scores = exact_scores(_matrix(asked["v"], wide), _matrix(candidates["v"], wide))
        ids, labels, out = candidates["id"].to_numpy(), candidates["label"].to_numpy(), []
        for row, (anchor, label, wanted) in enumerate(
                zip(asked["id"], asked["label"], asked["positives"])):
            limits = [window(int(p["score"])) for p in wanted]
            low, high = min(l for l, _ in limits), max(h for _, h in limits)
            of = scores[row]
            place = np.flatnonzero((of >= low) & (of <= high) & (labels != label)
                                   & (ids != anchor))
            place = place[np.lexsort((ids[place], -of[place]))]
            for p, (low, high) in zip(wanted, limits):
                at = place[first_in_window(ids[place], of[place], low, high, k)]
                if len(at):
                    out.append(pd.DataFrame({
                        "anchor_id": anchor, "place": p["place"], "positive_id": p["id"],
                        "positive_score": p["score"], "id": ids[at], "score": of[at]}))
        return pd.concat(out, ignore_index=True) if out else _NONE

    # Blocks of one label: as many as its rows and its anchors need.
    shape = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("asked")).join(
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    blocks_a = blocks_of(F.col("asked"), anchor_rows)
    blocks_c = blocks_of(F.col("n"), block_rows)
    own = dealt(rows.join(shape, "label"), "c", "a", blocks_c, blocks_a)
    askers = dealt(anchors.join(shape, "label"), "a", "c", blocks_a, blocks_c)
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id")
    found = (
        units(askers.drop("n", "asked"), own.drop("n", "asked"), ["label"], best_of_label)
        .withColumn("place", F.row_number().over(best).cast("long"))
        .where(F.col("place") <= positives)
        .groupBy("anchor_id").agg(F.collect_list(F.struct("place", "id", "score"))
                                  .alias("positives"))
    )
    # Blocks of all rows.
    blocks_a, blocks_c = (blocks_of(F.lit(c), size) for c, size in
                          ((n_anchors, anchor_rows), (n, block_rows)))
    opened = stored(anchors.join(found, F.col("id") == F.col("anchor_id"))
                    .select("id", "label", "v", "positives"), "negatives-opened")
    askers = dealt(opened, "a", "c", blocks_a, blocks_c)
    everything = dealt(rows, "c", "a", blocks_c, blocks_a)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id")
    return (
        units(askers, everything, [], in_windows)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))
    )
