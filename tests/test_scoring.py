"""What a scorer is fed: bounded slices, whatever is kept beside the replies."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from turnscore.operators import scoring as sc


def sizes():
    def call(batch):
        chars = sum(len(batch[c].iloc[i] or "") for c in ("context", "response", "prompt") for i in range(len(batch)))
        return pd.Series([f"{len(batch)} {chars}"] * len(batch), dtype="object")

    return call


def test_long_contexts_reach_the_scorer_in_bounded_slices(spark):
    df = spark.range(3000).coalesce(1).select(
        F.col("id").cast("string").alias("uid"), F.repeat(F.lit("x"), 4000).alias("context"), F.lit("r").alias("response"),
        F.when(F.col("id") % 2 == 0, F.repeat(F.lit("p"), 4000)).alias("prompt"))
    out = sc.batch_score(df, sizes, keep=("uid",))
    assert out.columns == ["uid", "reply", "call_failed"]
    rows = out.collect()
    assert [r["uid"] for r in rows] == [str(i) for i in range(3000)] and not any(r["call_failed"] for r in rows)
    seen = [tuple(map(int, r["reply"].split())) for r in rows]
    assert max(n for n, _ in seen) <= 1024 and max(c for _, c in seen) <= 4 << 20
    assert abs(sum(c / n for n, c in seen) - (3000 * 4001 + 1500 * 4000)) < 1


def test_slices_keep_every_row_and_a_long_row_alone():
    batch = pa.record_batch([pa.array(["a", "b" * (5 << 20), "", None, "c"])], names=["context"])
    parts = list(sc._slices(batch))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= sc.MOST_BYTES for p in parts)
    assert list(sc._slices(batch.slice(0, 0))) == []


def test_a_failing_slice_is_called_row_by_row(spark):
    def build():
        def call(batch):
            if (batch["response"] == "bad").any():
                raise sc.ScorerError("no answer")
            return pd.Series(["4.5"] * len(batch), dtype="object")

        return call

    df = spark.createDataFrame([("a", "c", "ok", 1), ("b", None, "bad", None), (None, "c", "ok", 3)], "uid string, context string, response string, n int").coalesce(1)
    got = [tuple(r) for r in sc.batch_score(df, build).collect()]
    assert got == [("a", "c", "ok", 1, "4.5", 0), ("b", None, "bad", None, "3.0", 1), (None, "c", "ok", 3, "4.5", 0)]
