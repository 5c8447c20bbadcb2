"""W1 and M1 for turns that arrive over time (Structured Streaming).

The reference builds a turn's history with a per-dialogue dictionary that it
appends to while it walks the turn file. The streaming form keeps exactly
that per-dialogue state in Spark's state store
(``applyInPandasWithState``): each micro-batch emits the context of every
new turn and appends the turn to its dialogue's state. State is one
dialogue's kept turns (its history), checkpointed with the query.

Turns must arrive in turn order within a dialogue (a late earlier turn
would not be inserted into contexts already emitted); the batch operator
:func:`turnscore.operators.dialogues.dialogue_context` has no such
requirement.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

_OUT = "uid string, dialogue_id long, turn_id long, context string"
_STATE = "turns array<string>"


def _history(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    hist = list(state.get[0]) if state.exists else []
    new = pd.concat(list(pdfs), ignore_index=True).sort_values("turn_id")
    ctx = []
    for t in new["text"]:
        ctx.append("\n".join(hist))
        hist.append((t or "").strip())
    state.update((hist,))
    yield pd.DataFrame({"uid": new["uid"].to_numpy(), "dialogue_id": new["dialogue_id"].to_numpy(),
                        "turn_id": new["turn_id"].to_numpy(), "context": ctx})


def stream_dialogue_context(turns: DataFrame) -> DataFrame:
    """Streaming W1 over ``(uid, dialogue_id, turn_id, text)``: the context
    of every arriving turn (earlier turns of its dialogue, stripped, joined
    by newline). Use output mode ``append``."""
    return turns.select("uid", "dialogue_id", "turn_id", "text").groupBy("dialogue_id").applyInPandasWithState(
        _history, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def score_micro_batches(contexts: DataFrame, turns: DataFrame, results_root: str, run_id: str, checkpoint: str,
                        prompt_name: str = "op-all-02", scorer=None, trigger_available_now: bool = True):
    """M1 on a stream: every micro-batch of new contexts is joined to its
    turns, scored with the batch scorer, parsed, and appended to the results
    table (S9) under ``run_id``. Returns the started query."""
    from turnscore.functions import prompts, replies
    from turnscore.operators import scoring
    from turnscore.sources import io

    prompt = prompts.get_prompt(prompt_name)

    def each(batch: DataFrame, epoch: int) -> None:
        pairs = batch.join(turns.select("uid", F.col("text").alias("response")), "uid")
        pairs = pairs.withColumn("prompt", prompts.render_prompt(prompt))
        raw = scoring.batch_score(pairs, scorer, keep=("uid",))
        parsed = replies.parse_replies(raw, prompt.qualities, "reply", keep=("uid", "call_failed"))
        # one part per (run, epoch): a re-run epoch after a failure
        # replaces its own rows (exactly-once output with the checkpoint)
        io.write_results(parsed, results_root, run_id, {"epoch": epoch})

    w = contexts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()
