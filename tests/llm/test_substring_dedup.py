"""Anchored substring dedup against counting every window."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.conftest import SMALL
from turnscore.llm import exchange, queries, substring_dedup


def brute(rows, length=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (k, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.dedup_substrings(docs, ["doc_id"], with_text=True, **options).collect()
    return sorted((tuple(r) for r in out), key=str)


def made_up(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "x\u3000y"]
    passages = [r.choices(words, k=k) for k in (34, 35, 36, 55, 80)]
    rows = []
    for i in range(60):
        w = r.choices(words, k=r.randint(0, 70))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    same = " ".join(r.choices(words, k=50))
    rows += [(60, None), (61, ""), (62, " \n"), (63, same), (64, same), (64, same), (None, same), (65, "a " * 120), (66, "b " * 36), (67, "b " * 35),
             (68, "c " * 35), (69, " ".join(passages[3] + ["z"] + passages[3]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_every_repeated_window_goes(spark, monkeypatch, seed):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 1 << 12)
    monkeypatch.setattr(exchange, "BUCKET_ENTRIES", 1 << 8)
    rows = made_up(seed)
    assert run(spark, rows) == brute(rows)


def test_other_lengths(spark):
    rows = made_up(3)
    assert run(spark, rows, length=21) == brute(rows, 21)
    with pytest.raises(ValueError):
        run(spark, rows[:1], length=20)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_cover_aligns_any_two_positions():
    cover, period = set(substring_dedup.COVER), substring_dedup.PERIOD
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


def test_query_on_whole_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op5_substring_dedup"](spark, SMALL).collect()), key=str)
    assert got == [r[:4] for r in brute(rows)] and any(r[2] for r in got)
