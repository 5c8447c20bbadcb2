"""Cells and blocks lose no link and add none."""

import numpy as np
import pytest

from tests.conftest import SMALL
from turnscore.llm import embedding_dedup as E
from turnscore.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = [
        lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        for _, v, lab in rows
    ]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                linked[i, j] = linked[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    ids = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            ids[r] = min(ids.get(r, rows[i][0]), rows[i][0])
    return sorted(((k, int(linked[i].sum()), ids.get(root[i])) for i, (k, _, _) in enumerate(rows)), key=str)


def made_up(seed, n=160, size=8):
    r = np.random.RandomState(seed)
    rows = []
    centres = r.randn(12, size)
    for i in range(n):
        v = centres[r.randint(12)] + r.randn(size) * r.choice([0.02, 0.1, 0.3]) if r.rand() < 0.8 else r.randn(size)
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1.0, 3.0])], int(r.randint(3))))
    v = rows[0][1]
    rows += [(200, v, 0), (201, v, 0), (201, v, 0), (None, v, 0), (202, v, None), (203, None, 0), (204, [], 0), (205, [0.0] * size, 0),
             (206, [float("nan"), *v[1:]], 0), (207, [float("inf"), *v[1:]], 0), (208, [None, *v[1:]], 0), (209, v[:4], 0), (210, v[:4], 0),
             (211, [x * 1e-30 for x in v], 0), (212, [x * 1e30 for x in v], 0)]
    return rows


def run(spark, rows):
    out = E.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


@pytest.mark.parametrize("seed, cell, block", [(1, 2048, 2048), (2, 10, 7)])
def test_links_equal_all_pairs(spark, monkeypatch, seed, cell, block):
    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = made_up(seed)
    assert run(spark, rows) == brute(rows)


def test_visits_reach_every_partner():
    r = np.random.RandomState(5)
    x = E.unit(r.randn(400, 6), 6)
    x = np.concatenate([x, E.unit(x + r.randn(400, 6) * 0.05, 6)])
    c = E.spherical_kmeans(x, 20)
    row, cell, home = E.visits(x, c, float(np.sqrt(2 - 2 * 0.98)))
    homes = dict(zip(row[home].tolist(), cell[home].tolist()))
    visited = set(zip(row.tolist(), cell.tolist()))
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
        assert (int(i), homes[int(j)]) in visited


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    odd = spark.createDataFrame([(1, [1.0], 0, "x", "y")], SCHEMA + ", id string, vector string")
    assert tuple(E.dedup(odd).first()) == (1, 0, 1, True)


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").limit(250).collect()]
    whole = queries.QUERIES["op2_embedding_near_dedup"](spark, SMALL)
    assert whole.count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count() and len(rows) == 250
    assert run(spark, rows) == brute(rows)
