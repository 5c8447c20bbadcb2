"""Whole jobs E1-E6: one public function each, DataFrame in, DataFrame out.

Each job is a single lazy plan; sinks are called by the caller (or by the
``*_to`` helpers) so Catalyst sees the whole DAG.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.operators import agreement as ag
from turnscore.operators import dialogues as dl
from turnscore.operators import mining as mn
from turnscore.operators import submissions as sb
from turnscore.schemas import HARD_SET_SIZE, SUBMISSION_ROWS


def build_submission(files: dict[str, DataFrame], expected_rows: int | None = SUBMISSION_ROWS) -> DataFrame:
    """Four scored files -> J3 -> A11 -> P1 (``0000``). With
    ``expected_rows`` the checks are enforced (one small action)."""
    merged = sb.merge_quality_files(files)
    if expected_rows is not None:
        chk = sb.submission_checks(merged, expected_rows).first()
        if not (chk["n_duplicate_uids"] == 0 and chk["n_incomplete"] == 0):
            raise ValueError(f"submission files disagree: {chk.asDict()}")
    out = dl.drop_first_turns(merged, "UID", "0000")
    if expected_rows is not None:
        n = out.count()
        if n != expected_rows:
            raise ValueError(f"submission has {n} rows, expected {expected_rows}")
    return out.drop("complete")


def grade_submission(gold: DataFrame, submission: DataFrame, subtask: str = "t2t", **slice_args) -> DataFrame:
    """P8 -> J2 -> P9 -> A7."""
    return ag.leaderboard(gold, submission, subtask, **slice_args)


def mine_hard_set(run: DataFrame, dataset: DataFrame, metric: str = "LLM", n: int = HARD_SET_SIZE,
                  id_col: str = "dialogue_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rank disagreement -> T1 -> T2 -> A12 -> J5. Returns the ranking,
    the source shares of the hardest rows (none without a ``model``; rows are
    told apart by id and model) and the hard subset of the dataset
    (the subset, as the option help says, not the full dataset)."""
    ids = [id_col, "model"] if "model" in run.columns else [id_col]
    ranking = mn.sort_by_gap(mn.rank_disagreement(run, metric, ids), id_col=ids)
    hard = mn.hardest(ranking, n, id_col=ids)
    shares = mn.source_share(hard if "model" in hard.columns else hard.withColumn("model", F.lit(None).cast("string")))
    return ranking, shares, mn.hard_subset(dataset, hard, id_col)


def build_rehearsal(rehearsal_input: DataFrame, variant: str = "constant") -> DataFrame:
    """E5: P2 -> W2 -> A15 -> F6 (write with ``sinks.write_nested_json``)."""
    return dl.rehearsal_rows(rehearsal_input, variant)


def static_examples_block(store: DataFrame, prompt_name: str, seed: int = 42) -> str:
    """J12 / T4 / F2 for a prompt with static examples: ``n`` rated examples
    carrying every quality of the prompt, sampled reproducibly, rendered into
    one block. At most ``n`` rows reach the driver."""
    from turnscore.functions import prompts
    from turnscore.operators import retrieval as rt

    prompt = prompts.get_prompt(prompt_name)
    rated = store.where(rt.has_qualities("qualities", prompt.qualities))
    sample = rt.sample_examples(rated, prompt.n_examples, seed)
    ratings = {q: F.try_element_at(F.col("qualities"), F.lit(q)) for q in prompt.qualities}
    text = prompts.render_example(prompt, F.col("context"), F.col("response"), ratings)
    block = prompts.examples_block(sample.withColumn("_text", text).withColumn("_g", F.lit(0)), ["_g"],
                                   "sample_key", "_text").first()
    return block["examples"] if block else ""


def retrieved_examples_blocks(queries: DataFrame, store: DataFrame, prompt_name: str,
                              backup: DataFrame | None = None) -> DataFrame:
    """J9 -> J10 -> J11 -> F2 for a prompt with retrieved examples: per query
    (``query_id``, ``embedding`` of its context) the rendered block of its
    nearest rated examples. ``(query_id, examples)``."""
    from turnscore.functions import prompts
    from turnscore.operators import retrieval as rt

    prompt = prompts.get_prompt(prompt_name)
    if backup is None:
        filled = rt.with_backup(queries, store, prompt.n_examples, prompt.qualities, exclude_self=False)
    else:
        chosen = rt.similar_examples(queries, store, prompt.n_examples, prompt.qualities, exclude_self=False)
        filled = rt.backup_fill(chosen, queries, backup, prompt.n_examples, exclude_self=False)
    pay = rt.example_payload(filled, store, prompt.qualities)
    text = prompts.render_example(prompt, F.col("context"), F.col("response"), {q: F.col(q) for q in prompt.qualities})
    return prompts.examples_block(pay.withColumn("_text", text), ["query_id"], "rank", "_text")


def score_and_evaluate(
    pairs: DataFrame, prompt_name: str, scorer=None, gold: DataFrame | None = None,
    qualities: Sequence[str] | None = None, examples: DataFrame | str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F1 -> M1 -> F3-F5 -> A8 -> A3/A4 -> A6.

    ``pairs``: ``(uid, context, response)`` (history built, cleaned);
    ``gold``: long ``(uid, quality, gold)``; ``examples``: the block of a
    static-example prompt (a string) or per-turn blocks ``(uid, examples)``
    of a retrieval prompt. Returns the long scores, the parse-error totals
    and the per-quality agreement; ``n_missing`` there counts the annotated
    gold rows (of the prompt's qualities) that got no score."""
    from turnscore.functions import prompts, replies
    from turnscore.operators import scoring

    prompt = prompts.get_prompt(prompt_name)
    qs = tuple(qualities or prompt.qualities)
    block = None
    if isinstance(examples, str):
        block = F.lit(examples)
    elif examples is not None:
        pairs = pairs.join(examples.select("uid", F.col("examples").alias("_examples")), "uid", "left")
        block = F.coalesce(F.col("_examples"), F.lit(""))
    rendered = pairs.withColumn("prompt", prompts.render_prompt(prompt, examples=block))
    raw = scoring.batch_score(rendered, scorer, keep=("uid",))
    parsed = replies.parse_replies(raw, qs, "reply", default=prompt.default_missing_value, keep=("uid", "call_failed"))
    # model calls are the expensive step: materialise the scores once in the
    # shared checkpoint folder so the evaluation branches (and a recomputed
    # task after an executor loss) never call the model again
    from turnscore.session import reliable_checkpoint

    parsed = reliable_checkpoint(parsed)
    errors = replies.parse_error_totals(parsed)
    agreement = None
    if gold is not None:
        wanted = gold.where(F.col("quality").isin(*qs)).select("uid", "quality", "gold")
        joined = wanted.join(parsed.select("uid", "quality", "score"), ["uid", "quality"], "left")
        agreement = ag.correlations(joined, ["quality"], "gold", "score", missing=True)
    return parsed, errors, agreement


def pooled_evaluation(long_by_set: dict[str, DataFrame]) -> DataFrame:
    """A10 over named train sets (long tables with quality, gold, score)."""
    u = sb.union_datasets(long_by_set)
    return ag.pooled_evaluation(u, "dataset")


__all__ = [
    "build_submission",
    "grade_submission",
    "mine_hard_set",
    "build_rehearsal",
    "score_and_evaluate",
    "static_examples_block",
    "retrieved_examples_blocks",
    "pooled_evaluation",
    "train_on_embeddings",
    "embed_and_train",
]


def embed_and_train(
    train_sets: dict[str, DataFrame], dev: DataFrame, gold: DataFrame, store_root: str, run_id: str = "run",
    id_col: str = "dialogue_id",
) -> DataFrame:
    """E6 end to end: U1 (pool the train sets) -> J4 (drop train rows whose
    context occurs in dev) -> M3 (embed responses) -> S7 (store train/dev
    embeddings, read them back) -> J6 (ensemble: embedding and its reverse)
    -> P11 (drop unlabelled) -> M5 -> T5 -> M6. ``gold``: ``(id, label)``.
    Returns dev predictions ``(id, prediction, gold)``."""
    from turnscore.operators import features as fe
    from turnscore.operators import gold as gd
    from turnscore.operators import scoring
    from turnscore.sources import io

    train = sb.drop_banned_contexts(sb.union_datasets(train_sets), dev.select("context"))
    spark = dev.sparkSession
    for split, df in (("train", train), ("dev", dev)):
        emb = scoring.pooled_embeddings(df.select(id_col, "response"), "response", id_col)
        io.write_embeddings(emb, store_root, run_id, split)
    parts = []
    for split in ("train", "dev"):
        e = io.read_embeddings(spark, store_root, run_id, split)
        m0 = e.select(id_col, "split", F.lit(0).alias("member"), "embedding")
        m1 = e.select(id_col, "split", F.lit(1).alias("member"), F.reverse("embedding").alias("embedding"))
        ens = fe.ensemble_features(m0.unionByName(m1), 2, id_col=id_col)
        parts.append(ens.withColumn("split", F.lit(split)))
    data = parts[0].unionByName(parts[1]).join(gold.select(id_col, "label"), id_col, "left")
    data, _ = gd.drop_unlabelled(data, "label")
    return train_on_embeddings(data)


def train_on_embeddings(data: DataFrame, reg_params: Sequence[float] = (0.0, 0.1, 1.0), label: str = "label",
                        split: str = "split") -> DataFrame:
    """E6 (after J6 / P11): fit candidates on ``train``, keep the best by dev
    Spearman (T5), predict ``dev`` (M6)."""
    from turnscore.operators import regression as rg

    train, dev = data.where(F.col(split) == "train"), data.where(F.col(split) == "dev")
    models = rg.fit_candidates(train, reg_params, label)
    best = rg.select_best(models, dev, 1, label)[0][0]
    return rg.predict(best, dev, label=label)
