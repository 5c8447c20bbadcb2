"""Rows that share ids or values: places, occurrences, gold, mining, grading."""

from __future__ import annotations

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from turnscore.operators import agreement as ag
from turnscore.operators import gold as gd
from turnscore.operators import identity
from turnscore.operators import mining as mn
from turnscore.operators import ranks
from turnscore.operators import submissions as sb
from turnscore.plans import checks
from turnscore.plans import datasets as ds
from turnscore.sources import catalogue as cg


def test_places_follow_the_file_in_every_format(spark):
    d = tempfile.mkdtemp(prefix="ts-place-")
    for part in range(2):
        rows = [f"{part},{i}" for i in range(500)]
        with open(f"{d}/p{part}.csv", "w") as f:
            f.write("\n".join(["a,b", *rows]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        csv = identity.with_place(spark.read.option("header", "true").csv(d), "csv")
        assert csv.rdd.getNumPartitions() > 4
        got = csv.repartition(7).orderBy(identity.PLACE).select("a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(int(r["a"]), int(r["b"])) for r in got] == [(p, i) for p in range(2) for i in range(500)]
    same = spark.range(100).select(F.lit(1).alias("x"))
    placed, seen = identity.placed(same, n=F.count(F.lit(1)))
    assert placed.select(identity.PLACE).distinct().count() == seen["n"] == 100


def test_occurrence_counts_across_blocks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i) for i in range(400)]
    place = F.struct(F.lit("f").alias("file"), F.floor(F.col("i") / 30).alias("block"), F.col("i").alias("row"))
    df = spark.createDataFrame(rows, "k string, i long").withColumn(identity.PLACE, place).repartition(5)
    seen: dict = {}
    for r in identity.occurrence(df, "k").orderBy("i").collect():
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["_nth"] == seen[r["k"]]


def _dataset(records, annotations):
    root = tempfile.mkdtemp(prefix="ts-ids-")
    import os

    path = cg.dataset_path("fed-turn", root)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(records, f)
    return root


def test_gold_per_row_where_ids_repeat(spark):
    """One dialogue answered by several models, one row standing twice."""
    rule, names = cg.lookup("fed-turn")

    def record(i, model, v):
        texts = {c: "x" for p in ("", "_zh", "_es", "_pa") for c in (f"context{p}", f"response{p}")}
        return {"dialogue_id": i, "model": model, **texts, "annotations": {n: [v, v + 1] for n in names}}

    records = [record("d1", "m1", 3.0), record("d1", "m2", 4.0), record("d2", "m1", 1.0), record("d2", "m1", 1.0), record("d3", "m1", float("nan"))]
    root = _dataset(records, names)
    pairs, gold = ds.load_dialogue_dataset(spark, root, "fed-turn", multiline=True)
    assert pairs.count() == 5
    got = sorted((r["dialogue_id"], r["model"], r["gold"]) for r in gold.where("quality = 'relevance' and gold is not null").collect())
    assert got == [("d1", "m1", 3.5), ("d1", "m2", 4.5), ("d2", "m1", 1.5), ("d2", "m1", 1.5)]
    assert "Exchange" not in checks.physical_plan(gold)
    _, _, agreement = ds.score_files(pairs, gold, "op-all-02")
    by = {r["quality"]: r for r in agreement.collect()}
    assert by["relevance"]["n"] == 4 and by["relevance"]["n_missing"] == 0
    first, some = ds.load_dialogue_dataset(spark, root, "fed-turn", multiline=True, max_turns=2)
    assert sorted((r["dialogue_id"], r["model"]) for r in first.collect()) == [("d1", "m1"), ("d1", "m2")]
    assert {r["model"] for r in some.collect()} == {"m1", "m2"}


def test_row_and_long_form_of_gold_agree(spark):
    rows = spark.createDataFrame([("d1", "persona-see", {"enjoy": 4.0, "avoid_rep": 2.0, "fluency": 3.0, "inquisitive": 5.0}),
                                  ("d2", "fed-turn", {"Understandable": 2.0, "Fluent": float("nan")}), ("d3", "no-such", {"x": 1.0})],
                                 "dialogue_id string, dataset string, values map<string,double>")
    long = rows.select("dialogue_id", "dataset", F.explode("values").alias("annotation", "value"))
    known = {(r["dialogue_id"], r["quality"]): r["gold"] for r in gd.composite_quality(long).collect()}
    got = {(r["dialogue_id"], r["quality"]): r["gold"] for r in gd.composite_rows(rows).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: pytest.approx(v) for k, v in known.items() if v is not None}
    assert got[("d2", "grammatical")] is None and ("d3", "relevance") not in got


def test_mining_keeps_equal_rows_and_null_patterns(spark):
    rows = [("d", None, 3.0, 1.0, 2.0), ("d", 3.0, None, 1.0, 2.0), ("e", 1.0, 1.0, 4.0, 4.0), ("e", 1.0, 1.0, 4.0, 4.0)]
    run = spark.createDataFrame(rows, "dialogue_id string, `annotations.relevance` double, `annotations.content` double, LLM_relevance double, LLM_richness double")
    got = sorted((r["dialogue_id"], r["mean_diff"]) for r in mn.rank_disagreement(run).collect())
    # relevance: gold 3 is third of 1, 1, 3; content likewise; scores 1 and 2 are the two smallest
    assert got == [("d", 1.5), ("d", 1.5), ("e", 2.0), ("e", 2.0)]
    assert mn.ranking_table(run).count() == 4
    with pytest.raises(ValueError, match="no gold column"):
        mn.rank_disagreement(run.select("dialogue_id", "`annotations.relevance`", F.col("LLM_richness").alias("LLM_tone")))


def test_repeating_easy_turns_changes_no_grade(spark):
    dims = ag.SUBTASK_DIMENSIONS["t2t"]
    columns = ", ".join(f"{d} double" for d in dims)
    rnd = random.Random(3)
    gold = spark.createDataFrame([(f"u{i}", "Chatbot", "A", "YES", *[float(i)] * 4) for i in range(10)], f"UID string, SID string, CID string, SUPERVISED string, {columns}")
    base = [(f"u{i}", *[float(i) if i < 5 else rnd.random() * 9] * 4) for i in range(10)]
    plain = spark.createDataFrame(base, f"UID string, {columns}")
    gamed = spark.createDataFrame(base + base[:5] * 3, f"UID string, {columns}")
    want = {r["dimension"]: (r["n"], r["spearman"], r["pearson"]) for r in ag.leaderboard(gold, plain).collect()}
    rows = ag.leaderboard(gold, gamed).collect()
    assert {r["dimension"]: (r["n"], r["spearman"], r["pearson"]) for r in rows} == want and {r["n_duplicates"] for r in rows} == {15}
    assert {r["n_duplicates"] for r in ag.leaderboard_slices(gold, gamed).collect()} == {15}
    with pytest.raises(ValueError, match="repeats UIDs"):
        ag.leaderboard(gold, gamed, strict=True)


def test_first_row_is_the_first_of_the_file(spark):
    d = tempfile.mkdtemp(prefix="ts-first-")
    with open(f"{d}/gold.csv", "w") as f:
        f.write("UID_TEST,RELEVANCE\n" + "\n".join(f"u{i % 50},{i}" for i in range(2000)) + "\n")
    gold = ds.read_challenge_csv(spark, f"{d}/gold.csv", ("RELEVANCE",)).repartition(9)
    turns = spark.createDataFrame([(f"u{i}",) for i in range(51)], "uid string")
    got = {r["uid"]: r["RELEVANCE"] for r in sb.gold_lookup(turns, gold, "uid").collect()}
    assert got == {**{f"u{i}": float(i) for i in range(50)}, "u50": None}


def test_merged_files_keep_every_row(spark):
    a = spark.createDataFrame([("u1", 1.0), ("u1", 1.0), ("u2", 2.0)], "UID string, v double").coalesce(1)
    b = spark.createDataFrame([("u1", 5.0), ("u2", 6.0), ("u2", 6.0)], "UID string, v double").coalesce(1)
    got = sorted((r["UID"], r["A"], r["B"], r["complete"]) for r in sb.merge_quality_files({"A": a, "B": b}).collect() if r["complete"])
    assert got == [("u1", 1.0, 5.0, True), ("u2", 2.0, 6.0, True)]
    assert sb.merge_quality_files({"A": a, "B": b}).count() == 4


def test_pearson_is_one_exchange_and_exact_far_from_zero(spark):
    rnd = random.Random(4)
    rows = [("q", 1e8 + rnd.randint(0, 9), 1e8 + rnd.randint(0, 9)) for _ in range(500)] + [("c", 1.0, float(i)) for i in range(5)] + [("n", None, 1.0)]
    df = spark.createDataFrame(rows, "quality string, gold double, score double").repartition(6)
    out = ag.pearson(df, ["quality"])
    assert checks.physical_plan(out).count("Exchange hashpartitioning") == 1
    near = df.where("quality = 'q'").select("quality", (F.col("gold") - 1e8).alias("gold"), (F.col("score") - 1e8).alias("score"))
    got = {r["quality"]: (r["n"], r["pearson"]) for r in out.collect()}
    both = {r["quality"]: r["pearson"] for r in ag.correlations(df, ["quality"]).collect()}
    exact = ag.pearson(near, ["quality"]).first()["pearson"]
    assert got["q"][1] == pytest.approx(exact, abs=1e-8) and both["q"] == pytest.approx(exact, abs=1e-12)
    assert got["c"] == (5, None) and got["n"] == (0, None) and both["c"] is None


def test_ranges_cut_correlations_and_ranks_alike(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), 3 + rnd.random() * 1e-6, float(rnd.randint(1, 5))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "q string, gold double, score double")
    key = lambda r: str(r["q"])
    one, many = (sorted(ag.correlations(df, ["q"], per_range=p).collect(), key=key) for p in (ranks.PER_RANGE, 50))
    assert [(r["q"], r["n"]) for r in one] == [(r["q"], r["n"]) for r in many]
    for x, y in zip(one, many):
        assert x["spearman"] == pytest.approx(y["spearman"], abs=1e-12) and x["pearson"] == pytest.approx(y["pearson"], abs=1e-9)
    one, many = (sorted(map(tuple, ranks.average_rank(df, "gold", ["q"], "rank", p).select("q", "gold", "rank").collect()), key=str) for p in (ranks.PER_RANGE, 50))
    assert one == many
