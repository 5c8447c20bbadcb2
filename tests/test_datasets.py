"""Loaders over challenge-format files written from the driver tables."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from turnscore.operators import agreement as ag
from turnscore.operators import dialogues as dl
from turnscore.plans import datasets as ds
from turnscore.schemas import TURN_DIMENSIONS
from turnscore.sources import adapters as ad
from turnscore.sources import catalogue as cg


def test_load_dialogue_dataset_from_json_array(spark):
    name = "persona-see"  # rule "first", richness lists one source twice
    rule, anns = cg.lookup(name)
    rows = ad.dialogue_rows(spark, SMALL).collect()
    recs = []
    for r in rows:
        recs.append({
            "dialogue_id": r["dialogue_id"], "model": r["model"], "context": r["context"], "response": r["response"],
            "context_zh": r["context_zh"], "context_es": r["context_es"], "context_pa": r["context_pa"],
            "response_zh": r["response_zh"], "response_es": r["response_es"], "response_pa": r["response_pa"],
            "annotations": {a: [float(1 + (r["conv_id"] + i + k) % 5) for k in range(2)] for i, a in enumerate(anns)},
        })
    root = tempfile.mkdtemp(prefix="ts-ds-")
    path = cg.dataset_path(name, root)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(recs, f)
    pairs, gold = ds.load_dialogue_dataset(spark, root, name, "par")
    got = {r["dialogue_id"]: r for r in pairs.collect()}
    assert len(got) == len(recs)
    some = recs[3]
    want_resp = "no response" if some["response_pa"] == "" else some["response_pa"].strip()
    assert got[some["dialogue_id"]]["response"] == want_resp
    g = {(r["dialogue_id"], r["quality"]): r["gold"] for r in gold.collect()}
    first = {a: some["annotations"][a][0] for a in anns}
    want_rich = (first["avoid_rep"] + 2 * first["enjoy"] + first["fluency"] + first["inquisitive"]) / 5
    assert g[(some["dialogue_id"], "richness")] == pytest.approx(want_rich)
    assert g[(some["dialogue_id"], "grammatical")] == pytest.approx(first["fluency"])
    scores, errors, agreement = ds.score_files(pairs, gold, "op-all-02")
    assert scores.count() == 4 * len(recs) and errors.count() == 4
    assert {r["quality"] for r in agreement.collect()} == {"appropriateness", "richness", "grammatical",
                                                           "relevance"}


def test_test_turns_and_grading_from_csv(spark):
    d = tempfile.mkdtemp(prefix="ts-csv-files-")
    t = ad.turns(spark, SMALL)
    turns_pdf = t.select(F.col("uid").alias("UID"), F.col("sid").alias("SID"),
                         F.col("text").alias("PARAPHRASES")).toPandas()
    turns_pdf.to_csv(f"{d}/turns.csv", index=False)
    gold = ad.turn_gold_wide(spark, SMALL).drop("LANGUAGE").toPandas()
    gold.to_csv(f"{d}/gold.csv", index=False)
    ad.submission_wide(spark, SMALL).toPandas().to_csv(f"{d}/sub.csv", index=False)

    pairs, g = ds.load_test_turns(spark, f"{d}/turns.csv", f"{d}/gold.csv")
    want = {r["uid"]: r["context"] for r in dl.dialogue_context(dl.drop_first_turns(t)).collect()}
    got = {r["uid"]: r for r in pairs.collect()}
    assert {u: r["context"] for u, r in got.items()} == want
    assert all(r["prefix_ok"] for r in got.values())
    assert g.where(~F.col("matched")).count() == 0 and g.count() == 4 * len(want)

    graded = {r["dimension"]: r for r in ds.grade_submission_files(spark, f"{d}/sub.csv", f"{d}/gold.csv").collect()}
    ref = {r["dimension"]: r for r in ag.leaderboard(ad.turn_gold_wide(spark, SMALL),
                                                     ad.submission_wide(spark, SMALL)).collect()}
    for dim in TURN_DIMENSIONS:
        assert graded[dim]["n"] == ref[dim]["n"]
        assert graded[dim]["spearman"] == pytest.approx(ref[dim]["spearman"])


def test_scoring_with_static_and_retrieved_examples(spark):
    from turnscore.plans import jobs
    from turnscore.plans.q_text import kept_pairs

    store = ad.store(spark, SMALL)
    pairs = kept_pairs(spark, SMALL)
    block = jobs.static_examples_block(store, "op-all-egs-rehearsal-copy-hard5-02")
    assert block.count("Talk so far:") == 5 and "relevance:" in block
    from turnscore.functions import prompts

    p = prompts.get_prompt("op-all-egs-rehearsal-copy-hard5-02")
    rendered = pairs.select(prompts.render_prompt(p, examples=F.lit(block)).alias("t"))
    assert rendered.where(F.col("t").contains("Marked talks")).count() == pairs.count()
    parsed, errors, _ = jobs.score_and_evaluate(pairs, "op-all-egs-rehearsal-copy-hard5-02", examples=block)
    assert parsed.count() == 4 * pairs.count()

    # retrieval: each turn's context is keyed by a vector of the store table
    # (the driver tables carry no text encoder, so the turn's dialogue id picks one)
    emb = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    keyed = pairs.withColumn("query_id", F.substring("uid", 6, 4).cast("long"))
    q = keyed.join(emb.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select(
        "query_id", "embedding").distinct()
    blocks = jobs.retrieved_examples_blocks(q, store, "vh-relevance-2egs-dd-zhao-retrieval-01")
    per_uid = keyed.join(blocks, "query_id").select("uid", "examples")
    assert per_uid.where(F.col("examples").contains("relevance:")).count() == per_uid.count() > 0
    parsed2, _, _ = jobs.score_and_evaluate(pairs, "vh-relevance-2egs-dd-zhao-retrieval-01", examples=per_uid)
    assert parsed2.count() == pairs.count()
