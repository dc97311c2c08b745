"""Residue products and windowed negatives against plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import hard_negatives as hn, queries as q


def plain_scores(a, b):
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return [[max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(u, v))))
             for v in whole[1]] for u in whole[0]]


@pytest.mark.parametrize("size,wide", [(200, 64), (5, 1), (2 ** 20, 300), (1e18, 130),
                                       (1e38, 70)])
def test_exact_scores(size, wide):
    draw = np.random.default_rng(wide)
    a, b = (np.floor(draw.uniform(-size, size, (n, wide))) for n in (7, 11))
    a[0], b[0] = size, -size
    assert hn.exact_scores(a, b).tolist() == plain_scores(a, b)


def test_primes_and_window():
    assert hn.primes(0) == [] and hn.primes(1) == [1021]
    found = hn.primes(10 ** 40)
    assert math.prod(found) > 2 * 10 ** 40 and len(set(found)) == len(found)
    assert all(hn.CHUNK * (p // 2) ** 2 < 2 ** 24 for p in found)
    for positive in [*range(-12, 40), 2 ** 62]:
        low, high = hn.window(positive)
        for s in {positive - 1, positive, positive * 4 // 5 - 1, positive * 4 // 5,
                  positive * 4 // 5 + 1, 0}:
            assert (low <= s <= high) == (80 * positive <= 100 * s <= 100 * positive)


def plain_negatives(rows, k=5, positives=5):
    """rows: (id, label, vector); ids may repeat."""
    out = []
    for anchor in sorted({i for i, _, _ in rows if i % 100 == 0}):
        label, vector = min((l, v) for i, l, v in rows if i == anchor)
        others = sorted(
            ((sum(int(x) * int(y) for x, y in zip(vector, v)), i, l) for i, l, v in rows
             if i != anchor), key=lambda r: (-r[0], r[1]))
        for score, i, _ in [r for r in others if r[2] == label][:positives]:
            fits = [r for r in others if r[2] != label
                    and 80 * score <= 100 * r[0] <= 100 * score]
            out += [(anchor, i, rank, r[1], score, r[0]) for rank, r in enumerate(fits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,anchor_rows", [(8192, 512), (9, 2)])
def test_like_plain_search(spark, block_rows, anchor_rows):
    draw = np.random.default_rng(8)
    # Few values, so that scores tie; a label that holds most rows; ids on several rows.
    rows = [(int(i), int(draw.choice([0, 0, 0, 1, 2])),
             [float(x) for x in draw.integers(-3, 9, 6)])
            for i in [*range(0, 1200, 10), 100, 100, 110, 110, 300]]
    rows.append((5, 77, [9.0] * 6))
    docs = spark.createDataFrame(rows, "id long, label long, v array<double>")
    found = hn.hard_negatives(docs, F.col("id") % 100 == 0, block_rows=block_rows,
                              anchor_rows=anchor_rows).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score,
                   r.negative_score) for r in found) == plain_negatives(rows)


def test_odd_rows_take_no_part(spark, tables, empty_tables):
    kept = hn.labelled(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "label",
                       "embedding", 256).collect()
    assert {r.id for r in kept} == {0, 50, 55, 54, 56, 57} - {r.id for r in kept if r.label is None}
    assert q.queries()["op13_hard_negatives"](spark, tables).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    q.queries()["op13_hard_negatives"](spark, tables).collect()
    assert q.queries()["op13_hard_negatives"](spark, empty_tables).count() == 0


def test_large_components(spark):
    rows = [(0, 1, [3e38, 1.0]), (7, 1, [2e38, 0.0]), (8, 2, [1.9e38, 5.0])]
    vectors = hn.labelled(spark.createDataFrame(rows, "i long, l long, e array<float>"),
                          "i", "l", "e", 256.0)
    assert all(v == math.floor(v) for r in vectors.collect() for v in r.v)
    found = hn.hard_negatives(vectors, F.col("id") == 0).collect()
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in found] == [
        (7, 8, 2 ** 63 - 1)]  # scores are held to the range of a long
