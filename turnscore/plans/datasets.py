"""Loading the challenge files as the reference's scripts do, composed from
the inventory operators (no new operators):

* :func:`load_dialogue_dataset` - S4 path -> S1 read -> A1 -> A2 -> J4 ->
  P3 -> P4/P5/P6: prepared ``(dialogue_id, model, context, response)`` pairs
  and a long gold table ``(dialogue_id, quality, gold)``.
* :func:`load_test_turns` - S2 reads -> P1 -> W1 (+P6) -> J1: test turns
  with their history and the looked-up gold.
* :func:`grade_submission_files` - S2 reads -> E3.
* :func:`score_files` - E1 over a loaded dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.operators import dialogues as dl
from turnscore.operators import gold as gd
from turnscore.operators import submissions as sb
from turnscore.operators.identity import PLACE, with_place
from turnscore.schemas import DIAL_DIMENSIONS, DIMENSION_TO_QUALITY, TURN_DIMENSIONS, dialogue_schema
from turnscore.sources import catalogue as cg
from turnscore.sources import io


def load_dialogue_dataset(
    spark: SparkSession, root: str, dataset: str, eval_type: str = "en", insert_speaker: bool = False,
    banned_contexts: DataFrame | None = None, multiline: bool | None = None, max_turns: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One dev/train dataset: prepared pairs and long gold, both with the
    dialogue's id, model and place in the file, so a dialogue that several
    models answered, or that the file repeats, has a pair and gold for each.
    ``max_turns`` keeps the first rows in the order of the file (T3); the gold
    follows the kept rows."""
    rule, annotations = cg.lookup(dataset)
    raw = io.read_dialogue_json(spark, cg.dataset_path(dataset, root), dialogue_schema(annotations), multiline, place=True)
    if banned_contexts is not None:  # J4 on the raw English context
        raw = sb.drop_banned_contexts(raw, banned_contexts.select("context"))
    keys = ("dialogue_id", "model", PLACE)
    if max_turns is not None:
        raw = sb.cap_rows(raw, max_turns, (PLACE,))
    pairs = dl.prepare_pairs(dl.language_variant(raw, eval_type, keep=keys), insert_speaker=insert_speaker)
    values = gd.annotation_values(F.col("annotations"), annotations, F.lit(rule))
    rows = raw.select(*keys, F.lit(dataset).alias("dataset"), values.alias("values"))
    return pairs, gd.composite_rows(rows, keep=keys).drop("dataset")


def read_challenge_csv(spark: SparkSession, path: str, doubles=()) -> DataFrame:
    """A challenge CSV read by header *names* (files differ by subtask: task 1
    adds ``LANGUAGE``, dialogue level has other dimensions), each row with its
    place in the file; the rating columns present are cast to double,
    everything else stays a string."""
    r = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    df = with_place(r.csv(path), "csv")
    return df.select(*[F.col(c).cast("double").alias(c) if c in doubles else F.col(c) for c in df.columns])


_ALL_DIMS = tuple(TURN_DIMENSIONS) + tuple(DIAL_DIMENSIONS)


def load_test_turns(
    spark: SparkSession, turns_csv: str, gold_csv: str, insert_speaker: bool = False,
    max_examples: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Task 2 test turns (``UID, SID, PARAPHRASES``): first turns dropped, the
    history of each turn (optionally speaker-tagged), the raw paraphrase as
    response, and the turn gold looked up by ``UID_TEST`` (first row wins,
    ``matched`` flags turns without gold) as a long table by quality."""
    turns = read_challenge_csv(spark, turns_csv).select(
        F.col("UID").alias("uid"), F.col("SID").alias("sid"), F.col("PARAPHRASES").alias("text"),
        F.get(F.split("UID", "-", -1), 1).alias("dialogue_key"),
        F.get(F.split("UID", "-", -1), 2).cast("long").alias("turn_id"),
        (F.get(F.split("UID", "-", -1), 0) == "TEST").alias("prefix_ok"),
    )
    kept = dl.drop_first_turns(turns, "uid", "000")
    hist = dl.dialogue_context(kept, "dialogue_key", "turn_id", "text", insert_speaker=insert_speaker)
    pairs = hist.select("uid", "sid", "prefix_ok", "context", F.col("text").alias("response"))
    if max_examples is not None:  # T3: after the history, so contexts stay whole
        pairs = sb.cap_rows(pairs, max_examples, ("uid",))
    gold_file = read_challenge_csv(spark, gold_csv, _ALL_DIMS)
    looked = sb.gold_lookup(pairs.select("uid"), gold_file, uid="uid", gold_key="UID_TEST")
    gold = gd.challenge_to_long(looked.withColumnRenamed("uid", "UID"))
    return pairs, gold.join(looked.select("uid", "matched"), "uid")


def grade_submission_files(
    spark: SparkSession, submission_csv: str, gold_csv: str, subtask: str = "t2t", **slice_args
) -> DataFrame:
    """E3 on challenge files (dimension, n, |rho|, |r|)."""
    from turnscore.plans.jobs import grade_submission

    sub = read_challenge_csv(spark, submission_csv, _ALL_DIMS)
    gold = read_challenge_csv(spark, gold_csv, _ALL_DIMS)
    return grade_submission(gold, sub, subtask, **slice_args)


def score_files(pairs: DataFrame, gold: DataFrame, prompt_name: str, scorer=None):
    """E1 over loaded pairs and long gold, both keyed by ``uid`` or by the
    dialogue's id, model and place (then the scores' ``uid`` is these as JSON)."""
    from turnscore.plans.jobs import score_and_evaluate

    key = F.col("uid") if "uid" in pairs.columns else F.to_json(F.struct(*[c for c in ("dialogue_id", "model", PLACE) if c in pairs.columns]))
    p = pairs.select(key.alias("uid"), "context", "response")
    g = gold.select(key.alias("uid"), "quality", "gold")
    return score_and_evaluate(p, prompt_name, scorer, g)


__all__ = [
    "load_dialogue_dataset",
    "load_test_turns",
    "grade_submission_files",
    "score_files",
    "DIMENSION_TO_QUALITY",
]
