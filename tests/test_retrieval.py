"""Pivot-pruned nearest neighbours against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscore.operators import retrieval as rt


def frames(spark, q, s):
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)], "ex_id long, embedding array<float>")
    return queries.repartition(3), store.repartition(4)


def brute(q, s, k, exclude_self):
    q, s = q.astype(np.float32).astype(float), s.astype(np.float32).astype(float)
    out = []
    for i, x in enumerate(q):
        d = ((s - x) ** 2).sum(axis=1)
        if exclude_self and i < len(s):
            d[i] = np.inf
        order = np.lexsort((np.arange(len(s)), d))[:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(order) if np.isfinite(d[j])]
    return out


def clustered(seed, n, clusters, dims=16, spread=0.05):
    r = np.random.RandomState(seed)
    return r.randn(clusters, dims)[r.randint(0, clusters, n)] + spread * r.randn(n, dims)


def found(df):
    return sorted((r["query_id"], r["ex_id"], r["rk"]) for r in df.collect())


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("pivots", [1, 7, None])
def test_equal_to_all_distances(spark, monkeypatch, exclude_self, pivots):
    monkeypatch.setattr(rt, "STORE_BLOCK", 50)
    monkeypatch.setattr(rt, "VISIT_BLOCK", 40)
    s = clustered(1, 400, 8)
    s[100:200] = s[3]  # one vector that a quarter of the store shares
    q = np.concatenate([s[:120], np.random.RandomState(2).randn(30, 16) * 5])
    queries, store = frames(spark, q, s)
    assert found(rt.nearest(queries, store, 5, exclude_self, pivots)) == sorted(brute(q, s, 5, exclude_self))


def test_few_distances_on_clustered_vectors(spark):
    s = clustered(3, 6000, 60)
    queries, store = frames(spark, s, s)
    cand = rt.candidates(queries, store, 3)
    computed = cand.agg(F.sum("computed")).first()[0]
    assert 0 < computed < 0.1 * len(s) ** 2
    some = brute(s[:40], s, 3, True)
    assert [x for x in found(rt.nearest(queries, store, 3)) if x[0] < 40] == sorted(some)


def test_small_and_empty_stores(spark):
    s = clustered(4, 3, 2)
    queries, store = frames(spark, s, s)
    assert found(rt.nearest(queries, store, 5)) == sorted(brute(s, s, 5, True))
    assert rt.nearest(queries, store.where("false"), 5).count() == 0 == rt.nearest(queries.where("false"), store, 5).count()


def test_vectors_without_clusters_are_sent_once_per_block(spark, monkeypatch):
    """Every cell is visited, yet no table grows with queries times cells."""
    monkeypatch.setattr(rt, "LEAST_BLOCK", 200, raising=False)
    rows, real = [], rt.written

    def counted(df, **metrics):
        back, seen = real(df, **metrics)
        rows.append(back.count())
        return back, seen

    monkeypatch.setattr(rt, "written", counted)
    s = np.random.RandomState(5).randn(1500, 32)
    queries, store = frames(spark, s, s)
    assert [x for x in found(rt.nearest(queries, store, 4)) if x[0] < 50] == sorted(brute(s[:50], s, 4, True))
    assert max(rows) <= len(s)


def test_repeated_keys_and_equal_vectors(spark, monkeypatch):
    """Of 900 equal vectors only the smallest ids count; a repeated id is left out as a whole."""
    monkeypatch.setattr(rt, "PAIRS", 64)
    monkeypatch.setattr(rt, "KEPT", 100)
    monkeypatch.setattr(rt, "TOGETHER", 70)
    s = clustered(6, 1000, 4)
    s[100:] = s[0]
    _, store = frames(spark, s, s)
    store = store.unionByName(store.where("ex_id in (0, 100, 101)"))
    queries = store.select(F.col("ex_id").alias("query_id"), "embedding").where("query_id in (0, 5, 100, 999)").distinct()
    got = {}
    for q, e, _ in found(rt.nearest(queries, store, 4)):
        got.setdefault(q, []).append(e)
    assert (got[0], got[100], got[999]) == ([100, 100, 101, 101], [0, 0, 101, 101], [0, 0, 100, 100])
    assert got[5] == sorted(i for _, i, _ in brute(s, s, 4, True)[20:24])


def test_groups_of_cells():
    starts, pieces = rt.groups_of(np.array([3, 4, 0, 25, 0, 2, 9, 1]), 10)
    assert (starts.tolist(), pieces.tolist()) == ([0, 3, 4, 6], [1, 3, 1, 1])
