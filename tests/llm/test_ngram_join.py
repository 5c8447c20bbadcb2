"""The heavy-light join against all pairs, on small made-up documents."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from turnscore.llm import exchange, ngram_join

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(rows, t=(90, 100), n=3):
    sets = [shingles(x, n) for _, x in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and t[1] * len(a & b) >= t[0] * len(a | b):
                parent[root(i)] = root(j)
    name = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            name[root(i)].append(k)
    return sorted(
        ((k, len(s), (min(name[root(i)]) if name[root(i)] else None) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str
    )


def near_copies(seed, n_bases=14, copies=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "ß", "X"]
    out = []
    for _ in range(n_bases):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 8, 12, 19, 20, 21, 22, 25, 40, 60, 120]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                if r.random() < 0.5:
                    w[r.randrange(len(w))] = r.choice(words)
                else:
                    w.insert(r.choice([0, len(w)]), r.choice(words))
            out.append(r.choice([" ", "\n", "  "]).join(w))
    passage = " ".join(r.choice(words) for _ in range(30))
    out += [" ".join(r.choice(words) for _ in range(20)) + " " + passage for _ in range(20)]
    r.shuffle(out)
    return [(i, x) for i, x in enumerate(out)]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.jaccard_components(docs, ["doc_id"]).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 1 << 14)
    monkeypatch.setattr(exchange, "BUCKET_ENTRIES", 1 << 10)
    rows = near_copies(seed)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (6, "a b"), (None, "q r s t"), (9, "q r s t"), (None, "only mine"),
            (10, " "), (11, "x" * 100_000)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 5), (2, "a b c d", "y", 6)], "doc_id long, text string, fp string, n_shingles int").drop("n_shingles")
    out = ngram_join.jaccard_components(docs, ["doc_id", "fp"]).collect()
    assert sorted((r.doc_id, r.fp, r.component_id) for r in out) == [(1, "x", 1), (2, "y", 1)]


def test_boundary_follows_the_cost():
    assert ngram_join.choose_boundary({5: 1000, 41: 0}) >= 5
    few, many = ngram_join.choose_boundary({30: 10, 41: 10}), ngram_join.n_subsets(30, 40)
    assert many > 4 * 30 and few < 30
    for a in range(1, 40):
        for b in range(a, 44):
            o = ngram_join.least_overlap(a, b)
            assert 100 * o >= 90 * (a + b - o) and 100 * (o - 1) < 90 * (a + b - o + 1)


def test_sets_are_built_from_small_slices(spark, monkeypatch):
    caught = []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run))
    ngram_join.set_table(docs, ["doc_id"])
    texts = [" ".join(f"w{i * j % 997}" for j in range(250)) for i in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["c0", "_text"])
    parts = list(caught[0](iter([batch])))
    assert max(sum(len(texts[i]) for i in p.column("c0").to_pylist()) for p in parts) <= 1 << 20
    whole = ngram_join.Sets(batch.column("_text"), ngram_join.SHINGLE)
    table = pa.Table.from_batches(parts)
    assert table["c0"].to_pylist() == list(range(3000)) and table["fp"].to_pylist() == whole.keys()
