"""Codes against plain Python integers; candidate masks against all distances."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from turnscore.llm import queries
from turnscore.llm import vector_codes as V


def brute(rows, parts, entries=64, rounds=2):
    """(codes, codebooks) of (id, label, vector) in order of the ids."""
    rows = [r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(rows[0][2]) // parts
    cut = [[[math.floor(256 * x) for x in v[p * d : (p + 1) * d]] for p in range(parts)] for _, _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]

    for _ in range(rounds):
        groups = defaultdict(list)
        for c, a in zip(cut, assign()):
            for p, (_, k) in enumerate(a):
                groups[p, k].append(c[p])
        for (p, k), members in groups.items():
            books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    out, totals = [], defaultdict(int)
    for (i, label, _), a in zip(rows, assign()):
        error = sum(e for e, _ in a)
        totals[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in a), error, label))
    return sorted(((i, code, e, totals[label]) for i, code, e, label in out), key=str), books


@pytest.mark.parametrize("d", [1, 3, 4, 40])
@pytest.mark.parametrize("scale", [2, 60, 10**6])
def test_masks_keep_the_nearest_entry(d, scale):
    r = np.random.RandomState(d)
    entries, x = r.randint(-scale, scale, (64, d)), r.randint(-2 * scale, 2 * scale, (600, d))
    apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    code, error = V.Codebook(entries).nearest(x)
    assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
    mask = V.Codebook(entries).candidates(x, np.full(len(x), scale // 2))
    inside = (np.abs(x[:, None] - entries[None]) <= scale // 2).all(axis=2)
    assert (np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool) == inside).all()


ODD = [
    (None, 1, [0.5] * 8), (900, None, [0.25] * 8), (900, None, [0.25] * 8), (901, None, None), (902, 2, []), (903, 2, [math.nan] + [0.0] * 7),
    (904, 2, [math.inf] + [0.0] * 7), (905, 2, [None] + [0.0] * 7), (906, 3, [0.0] * 8), (906, 4, [-1e-9] * 8), (907, 4, [1000.0, -1000.0] * 4),
]


@pytest.mark.parametrize("n, entries", [(0, 64), (20, 64), (150, 16)])
def test_codes_equal_plain_integers(spark, n, entries):
    r = np.random.RandomState(n)
    centre = r.randn(5, 8)
    rows = [(i, int(i % 3), (centre[i % 5] + 0.1 * r.randn(8)).tolist()) for i in range(n)] + ODD
    out, books = V.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5), parts=4, entries=entries)
    want, own = brute(rows, 4, entries)
    assert sorted(((x.vec_id, x.code, x.error, x.label_error) for x in out.collect()), key=str) == want
    assert [b.tolist() for b in books] == own


def test_other_lengths_and_large_components_have_a_defined_result(spark):
    rows = [(1, 1, [0.5] * 4), (2, 1, [0.5] * 6), (3, 1, [1e30] * 4), (4, 1, [0.75] * 4)]
    out, books = V.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), parts=2)
    assert sorted((x.vec_id, x.code) for x in out.collect()) == [(1, "0000"), (2, None), (4, "0101")]
    out, books = V.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), parts=3)
    assert sorted((x.vec_id, x.code, x.label_error) for x in out.collect()) == [(1, None, None), (2, None, None), (4, None, None)] and books == []


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 7, [0.5, 1.0], "x", 3)], "key long, kind int, v array<double>, _id string, code int")
    assert [(r.key, r.kind, r.code, r.error) for r in V.compress(rows, "key", "v", "kind", parts=2)[0].collect()] == [(1, 7, "0000", 0)]
    assert V.compress(rows.where("false"), "key", "v", "kind")[0].count() == 0


def test_query_on_all_embeddings(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want, books = brute(rows, 16)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = queries.QUERIES["op11_vector_codes"](spark, SMALL).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want and {r.codebooks_sha256 for r in got} == {digest}
