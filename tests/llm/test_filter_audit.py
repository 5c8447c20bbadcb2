"""The audit against plain Python over all orders; tries against dictionaries."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tests.conftest import SMALL
from turnscore.llm import filter_audit as A
from turnscore.llm import queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs (id, text, lang), labels (id, quality, toxic)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    rows = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, c in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t),
            i is not None and i > first[t])) if c}
        rows[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, members in rows.items():
        shapley, own = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                own.append([part, "".join(order), k + 1, len(left), len(gone), sum(f in m[0] for m in members) - len(gone), sum(m[0] == {f} for m in members),
                            sum(m[1] for m in gone), sum(m[2] for m in gone), f])
        out += [tuple(r[:-1]) + (shapley[r[-1]],) for r in own]
    return sorted(out)


def run(spark, docs, labels, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    out = A.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


def made_up(seed):
    r = random.Random(seed)
    words = ["w" + "".join(r.choices("abcdefghij", k=3)) for _ in range(300)] + ["É", "UPPER", "CASE"]
    docs = []
    for i in range(60):
        text = r.choice([" ", "\n", "\t "]).join(r.sample(words, r.randint(90, 130))) if r.random() < 0.7 else " ".join(r.choices(words[:60], k=r.randint(1, 250)))
        if r.random() < 0.2:
            text += r.choice("#$%&*|")
        if r.random() < 0.2:
            text = text.upper()
        docs.append((i, text, r.choice(["en", "de", "", None])))
    docs += [(100 + i, docs[i % 7][1], "en") for i in range(30)] + [(200 + i, docs[0][1], None) for i in range(40)]  # a hot text
    docs += [(50, None, "en"), (51, "", "en"), (52, "", None), (None, "x", "de"), (None, docs[1][1], "en"), (3, docs[3][1], "de"), (3, docs[4][1], "de"), (5, " \n", "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_plain_counts(spark, monkeypatch, seed):
    monkeypatch.setattr(A, "TRIE_BYTES", 2000)
    monkeypatch.setattr(A, "TASK_BYTES", 8000)
    docs, labels = made_up(seed)
    assert run(spark, docs, labels) == brute(docs, labels)


def test_tries_keep_the_smallest_id():
    r = random.Random(4)
    texts = [bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(3000)] + [b"x" * 100_000, b"x" * 100_001, b"x" * 50_000 + b"y"]
    trie, want = A.TextTrie(), {}
    for t in texts:
        i = r.randint(0, 10**6)
        trie.insert(t, i, t)
        want[t] = min(want.get(t, i), i)
    assert {key: least for least, key in trie.terminals()} == want


def test_ranges_follow_the_text_and_split_long_common_prefixes(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcdefgh", k=n))
    head = word(3000)
    texts = [word(40) for _ in range(200)] + [head + word(40) for _ in range(400)] + ["same " * 50] * 300
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", A.F.xxhash64("text"))
    cuts = A.bounds(rows, len(texts), 16)
    assert cuts == sorted(set(cuts)) and len(cuts) > 8 and min(map(len, cuts)) < 6
    sizes = Counter(A.bisect_right(cuts, t.encode()) for t in set(texts))
    assert max(sizes.values()) < 3 * len(set(texts)) / 16
    assert A.bounds(rows, 0, 16) == [] == A.bounds(rows, 10, 1)


def test_copies_move_once_per_batch(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i}") for i in range(3000)], "id long, text string").coalesce(1)
    seen = A.originals(rows).collect()
    assert len(seen) == 1001 and min(r.id for r in seen if r.id % 3) == 1
    assert "Python" not in A.interactions(spark.createDataFrame([("", 3, True, False, 2)], "part string, mask int, good boolean, toxic boolean, n long"), list("AB"))._jdf.queryExecution().toString()


def test_empty_tables_other_filters_and_clashing_columns(spark):
    assert run(spark, [], []) == []
    docs = spark.createDataFrame([("a", "x y", "en", 1, 2), ("b", "x y", "en", 1, 2)], "key string, body string, mask string, h int, n int")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int").withColumnRenamed("doc_id", "key")
    out = A.audit(docs, labels, {"S": A.F.length("text") < 3}, "key", "body", "mask", "U").collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.good_lost, r.shapley) for r in out) == [
        ("en", "SU", 1, 2, 0, 0, 0), ("en", "SU", 2, 1, 1, 1, 2), ("en", "US", 1, 1, 1, 1, 2), ("en", "US", 2, 1, 0, 0, 0)]


def test_query_on_whole_documents(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    got = queries.QUERIES["op12_filter_audit"](spark, SMALL)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(docs, labels)
