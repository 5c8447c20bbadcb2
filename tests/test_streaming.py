"""Streaming W1 agrees with the batch operator when turns arrive in two
micro-batches; the micro-batch scorer appends parsed scores per run."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tests.conftest import SMALL
from turnscore.operators import dialogues as dl
from turnscore.sources import adapters as ad
from turnscore.sources import io
from turnscore.streaming.history import score_micro_batches, stream_dialogue_context


def _staged_turns(spark):
    t = ad.turns(spark, SMALL).select("uid", "dialogue_id", "turn_id", "text")
    src = tempfile.mkdtemp(prefix="ts-stream-src-")
    t.where("turn_id < 3").coalesce(1).write.mode("append").parquet(src)
    t.where("turn_id >= 3").coalesce(1).write.mode("append").parquet(src)
    return t, src


def test_streaming_history_matches_batch(spark):
    t, src = _staged_turns(spark)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ctx = stream_dialogue_context(stream)
    out = tempfile.mkdtemp(prefix="ts-stream-out-")
    q = (ctx.writeStream.format("parquet").option("path", out + "/data")
         .option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["uid"]: r["context"] for r in spark.read.parquet(out + "/data").collect()}
    want = {r["uid"]: r["context"] for r in dl.dialogue_context(t).collect()}
    assert got == want


def test_micro_batch_scoring(spark):
    t, src = _staged_turns(spark)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ctx = stream_dialogue_context(stream.where(F.col("turn_id") > 0))
    base = tempfile.mkdtemp(prefix="ts-stream-score-")
    q = score_micro_batches(ctx, t, base + "/results", "stream-run", base + "/ckpt")
    q.awaitTermination(300)
    res = io.read_results(spark, base + "/results", "stream-run")
    n_turns = t.where("turn_id > 0").count()
    assert res.count() == 4 * n_turns
    assert res.select("uid").distinct().count() == n_turns
