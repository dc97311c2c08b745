"""Largest products against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import queries as q, topk


@pytest.mark.parametrize("spread", [0.0, 0.3, 1.5])
def test_like_all_products(spark, spread):
    draw, n = np.random.default_rng(4), 400
    vectors = draw.normal(size=(n, 6)) * np.exp(spread * draw.normal(size=(n, 1)))
    vectors[::9] = vectors[5]
    vectors[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_products(topk.scaled(table, "vec_id", "embedding", 256), F.col("id") % 20 == 0,
                            5, bucket_rows=40, query_rows=8).collect()
    whole = np.floor(vectors * 256).astype(np.int64)
    expected = []
    for query in range(0, n, 20):
        scores = whole @ whole[query]
        order = [i for i in np.lexsort((np.arange(n), -scores)) if i != query][:5]
        expected += [(query, r + 1, i, scores[i]) for r, i in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_awkward_vectors(spark, tables):
    rows = q.queries()["op6_top_products"](spark, tables).collect()
    assert {r.query_id for r in rows} == {0, 50}
    found = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 50]
    assert found == [(54, 32768), (57, 32768), (0, 8192), (55, 0), (56, -128)]


def test_pruning_keeps_all_results():
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(500, 5))
    bucket = topk.Bucket(np.arange(500), vectors)
    for _ in range(100):
        query = draw.normal(size=5)
        scores = bucket.vectors @ query
        for threshold in (scores.max(), np.sort(scores)[-20], scores.max() * 1.01, 0.1):
            places = bucket.candidates(query, threshold)
            assert set(np.flatnonzero(scores >= threshold)) <= set(places)


def test_products_beyond_doubles():
    big = np.array([[2.0 ** 40, 1.0]])
    assert topk._exact(big, big)[0, 0] == 2 ** 63 - 1
    mid = np.array([[2.0 ** 28, 1.0]])
    assert topk._exact(mid, mid)[0, 0] == 2 ** 56 + 1
