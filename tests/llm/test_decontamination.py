"""The FM-index against plain search."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from turnscore.llm import decontamination as D
from turnscore.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, bench, window=10):
    phrases = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add("null" if item is None else str(item))
    out = []
    for _, text in docs:
        w, items = words(text), set()
        hit = [False] * len(w)
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    items |= phrases[p]
                    hit[i : i + n] = [True] * n
        out.append((len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
    return out


def made_up(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "ß1"]
    bench = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 10, 11, 25])))) for i in range(12)] + [(3, "w1 w1"), (90, None), (91, "- , ."), (None, "only here once")]
    docs = []
    for i in range(60):
        w = r.choices(vocabulary, k=r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            w += r.choice([t for _, t in bench if t]).upper().split()
        docs.append((i, r.choice([" ", ", ", "\n-"]).join(w)))
    docs += [(60, None), (61, ""), (62, " .,"), (7, docs[7][1]), (7, docs[7][1]), (None, "ONLY here... once"), (63, "w1 " * 3000)]
    return docs, bench


def run(spark, docs, bench, **options):
    frame = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(docs)], "n long, doc_id long, text string").coalesce(2)
    items = spark.createDataFrame(bench, "item_id long, text string")
    return sorted(D.decontaminate(frame, items, ["n", "doc_id"], **options).collect(), key=lambda r: r.n)


@pytest.mark.parametrize("seed, limit, block", [(1, 1 << 20, 1 << 20), (2, 64, 1 << 20), (3, 1 << 20, 60)])
def test_hits_equal_plain_search(spark, monkeypatch, seed, limit, block):
    monkeypatch.setattr(D, "INDEX_WORDS", limit)  # in this process; tasks keep theirs
    docs, bench = made_up(seed)
    got = run(spark, docs, bench, block_bytes=block)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute(docs, bench)
    for (_, text), r in zip(docs, got):
        if text is None:
            assert r.clean_text is None
            continue
        cut = "".join(text[a:b] for a, b in zip([0, *[s.end for s in r.spans]], [*[s.start for s in r.spans], len(text)]))
        assert r.clean_text == cut and len(words("".join(text[s.start : s.end] + " " for s in r.spans))) == r.n_hit


def test_long_sequences_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(D, "INDEX_WORDS", 40)
    docs, bench = made_up(4)
    import pyarrow as pa

    texts = [t for _, t in docs]
    table = pa.table({"_text": pa.array(texts, pa.string()), "_spans": pa.array([b""] * len(texts), pa.binary()),
                      "_items": pa.array([[]] * len(texts), pa.list_(pa.string()))})
    phrases = D.Phrases(["null" if i is None else str(i) for i, t in bench if t is not None], [t for _, t in bench if t is not None], 10)
    got = D._finish(D._search(table, "_text", phrases), "_text", []).to_pylist()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == brute(docs, bench)


def test_suffix_order_and_index():
    r = np.random.RandomState(0)
    for n in (1, 2, 5, 50, 300):
        for k in (1, 2, 5, 40):
            s = np.r_[r.randint(1, k + 1, n), 0]
            order = D.suffix_order(s)
            assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
    pieces = [r.randint(0, 4, size).astype(np.uint64) for size in (30, 1, 17, 60)]
    index = D.FMIndex(pieces, sample=4)
    text = [[*p.tolist(), "|"] for p in pieces]
    flat = [x for p in text for x in p]
    for phrase in ([0], [1, 2], [3, 3, 0], [0, 1, 2, 3], [9], [2] * 10):
        symbols = index.symbols(np.array([phrase[::-1]], np.uint64))
        low, high = index.search(symbols, np.array([len(phrase)]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert found == [i for i in range(len(flat)) if flat[i : i + len(phrase)] == phrase]


def test_empty_tables_and_extra_columns(spark):
    bench = [(1, "a b c")]
    assert run(spark, [], bench) == []
    got = run(spark, [(1, "a b c")], [])
    assert (got[0].n_hit, got[0].contaminated, got[0].clean_text) == (0, False, "a b c")
    odd = spark.createDataFrame([(1, "x a b c", "p", "q")], "doc_id long, text string, _spans string, n_hit string").drop("n_hit")
    out = D.decontaminate(odd, spark.createDataFrame(bench, "item_id long, text string")).first()
    assert (out.doc_id, out._spans, out.n_hit, out.clean_text) == (1, "p", 3, "x ")


def test_query_equals_plain_search(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = {k: v for (k, _), v in zip(docs, brute(docs, bench))}
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_indexes_are_built_from_small_slices(spark, monkeypatch):
    caught, sizes, search = [], [], D._search
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self.selectExpr(*["1"] * 9))
    D.decontaminate(docs, spark.createDataFrame([(1, "w5 w5 w5")], "item_id long, text string"), ["doc_id"])
    monkeypatch.setattr(D, "_search", lambda t, *a: sizes.append(sum(len(x) for x in t["_text"].to_pylist())) or search(t, *a))
    texts = [" ".join(f"w{i * j % 997}" for j in range(250)) for i in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts), pa.array([b""] * 3000), pa.array([[]] * 3000, pa.list_(pa.string()))],
                            names=["_k0", "_text", "_spans", "_items"])
    tracemalloc.start()
    parts = list(caught[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) <= 2 << 20 and peak < 60 << 20
    assert sum(p.num_rows for p in parts) == 3000
