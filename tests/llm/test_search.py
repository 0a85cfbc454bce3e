"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldobs.llm import ann, topk
from fieldobs.llm.common import table


def vectors(spark, n=900, dims=16, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims)).round(1)
    x[n // 2:n // 2 + 20] = x[:20]  # ties
    x[7] = x[8] = 0
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block_rows,chunk_rows", [(100, 20), (10_000, 10_000)])
def test_top_products_equal_brute_force(spark, block_rows, chunk_rows):
    x, df = vectors(spark)
    steps = np.floor(x * 64)
    got = topk.top_products(df, df.where("vec_id % 20 = 0"), k=20, block_rows=block_rows, chunk_rows=chunk_rows)
    want = set()
    for q in range(0, len(x), 20):
        scores = steps @ steps[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        want |= {(q, rank, int(i), int(scores[i])) for rank, i in enumerate(order, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_threshold_stops_early():
    """Rows that stand out in one dimension end the search before the lists do."""
    x = np.zeros((5000, 4))
    x[:, 0] = np.arange(5000)
    lists, depths = topk.SortedLists(x), []
    met = topk.SortedLists.met
    topk.SortedLists.met = lambda self, a, b: depths.append(b) or met(self, a, b)
    try:
        got = topk.search_block(np.arange(5000), x, np.array([-1]), np.array([[1.0, 0, 0, 0]]), 3)
    finally:
        topk.SortedLists.met = met
    assert got["vec_id"].tolist() == [4999, 4998, 4997] and max(depths) <= 32
    assert lists.threshold(np.array([[1.0, 0, 0, 0]]), 16)[0] == 4984


@pytest.mark.parametrize("block_rows,chunk_rows", [(150, 5), (10_000, 10_000)])
def test_nearest_recall_and_scores(spark, block_rows, chunk_rows):
    x, df = vectors(spark)
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, block_rows=block_rows, chunk_rows=chunk_rows).collect()]
    norms = np.linalg.norm(x, axis=1)
    usable = np.flatnonzero(norms > 0)
    hits = total = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q] / np.where(norms > 0, norms * norms[q], np.inf)
        order = [i for i in usable[np.lexsort((usable, -scores[usable].round(12)))] if i != q][:5]
        mine = sorted(r for r in got if r[0] == q)
        assert [r[1] for r in mine] == [1, 2, 3, 4, 5]
        assert [r[3] for r in mine] == pytest.approx([scores[r[2]] for r in mine], abs=1e-12)
        assert all(a[3] > b[3] or (a[3] == b[3] and a[2] < b[2]) for a, b in zip(mine, mine[1:]))
        hits += len({r[2] for r in mine} & set(order))
        total += 5
    assert hits >= 0.9 * total


def test_recall_on_the_test_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    rows = df.orderBy("vec_id").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, total = rows["vec_id"].to_numpy(), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q]
        scores[q] = -2
        best = np.argsort(-scores)[:5]
        hits, total = hits + sum((ids[q], ids[i]) in got for i in best), total + 5
    assert hits >= 0.9 * total


def test_every_row_is_a_candidate(spark):
    _, df = vectors(spark, n=60)
    got = topk.top_products(df, df.where("vec_id = 0"), k=100)
    assert got.count() == 59
    assert ann.nearest(df, df.where("vec_id = 0"), k=100).select(F.countDistinct("vec_id")).first()[0] == 57
