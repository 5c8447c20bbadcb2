"""Bounded histories by a segmented scan against the plain window."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnscore.operators import dialogues as dl


@pytest.mark.parametrize("max_history", [1, 3, 50])
@pytest.mark.parametrize("block_size", [1, 4, 256])
def test_bounded_history_equals_the_window(spark, max_history, block_size):
    rnd = random.Random(1)
    rows = [(d, t, rnd.choice([None, "", " a ", f"text {t}"]), {"k": t}) for d in (1, 2, None) for t in rnd.sample(range(900), 120)]
    df = spark.createDataFrame(rows, "dialogue_id int, turn_id int, text string, more map<string,int>").repartition(5)
    for speaker in (False, True):
        plain, cut = (dl.dialogue_context(df, max_history=max_history, insert_speaker=speaker, block_size=b) for b in (None, block_size))
        key = lambda r: (str(r["dialogue_id"]), r["turn_id"])
        assert sorted(map(tuple, cut.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        assert len({key(r) for r in cut.collect()}) == len(rows)


def test_ordinals_number_sparse_turns(spark):
    df = spark.createDataFrame([(d, t * t) for d in range(3) for t in range(40)], "d int, t long").repartition(4)
    got = sorted(map(tuple, dl.ordinals(df, "d", "t", "i", 16).collect()))
    assert got == [(d, t * t, t) for d in range(3) for t in range(40)]


def test_one_long_dialogue_runs_in_bounded_tasks(spark):
    """A dialogue of 100,000 turns: no task gets more than a few blocks of it."""
    n, h = 100_000, 50
    df = spark.range(n).select(F.lit(7).alias("dialogue_id"), F.col("id").alias("turn_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = dl.dialogue_context(df, max_history=h).withColumn("task", F.spark_partition_id())
        seen = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("context", "\n"))).alias("most")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["n"] for r in seen) == n and max(r["n"] for r in seen) < n / 4 and max(r["most"] for r in seen) == h
    last = out.where(f"turn_id = {n - 1}").first()["context"]
    assert last == "\n".join(f"t{i}" for i in range(n - 1 - h, n - 1))
