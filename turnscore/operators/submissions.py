"""Submissions and gold lookup: J1, J2, J3, J4, A11, U1, U2, T3.

Everything aligns on the UID key with hash joins (the reference scans the
gold table once per turn, or aligns by row position).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.operators.identity import PLACE, occurrence, placed, written
from turnscore.schemas import SUBMISSION_ROWS, TURN_DIMENSIONS


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Deterministic "take the first row" per key: the row with the smallest
    ``order`` (partial aggregation, so a duplicated hot key stays cheap)."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_first"))
    return best.select(key, "_first.*")


def _ordered(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """``df`` with an ``order``: its own, or the values of ``cols`` where the rows
    carry no place (then equal rows are the only ties)."""
    return df if order in df.columns else df.withColumn(order, F.struct(*cols))


def first_per_uid(submission: DataFrame, cols: Sequence[str], uid: str = "UID", order: str = PLACE) -> DataFrame:
    """One row per UID, the first by its place in the file, and ``n_duplicates``,
    the rows of that UID beyond it."""
    rows = _ordered(submission.select(uid, *cols, *[order] * (order in submission.columns)), cols, order)
    best = rows.groupBy(uid).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_first"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return best.select(uid, "_first.*", "n_duplicates")


def gold_lookup(turns: DataFrame, gold: DataFrame, uid: str = "UID", gold_key: str = "UID_TEST",
                order: str = PLACE) -> DataFrame:
    """For each turn the first gold row with ``UID_TEST = UID``, first by
    ``order`` (by default the row's place in its file, see
    :mod:`turnscore.operators.identity`; by value where it has none);
    ``matched`` is false where none exists (the reference raises)."""
    dims = [d for d in TURN_DIMENSIONS if d in gold.columns]
    g = first_per_key(_ordered(gold.select(gold_key, *dims, *[order] * (order in gold.columns)), dims, order), gold_key, order)
    g = g.select(F.col(gold_key).alias("_k"), *dims, F.lit(True).alias("matched"))
    j = turns.join(g, turns[uid] == g["_k"], "left").drop("_k")
    return j.withColumn("matched", F.coalesce("matched", F.lit(False)))


def align(gold_long: DataFrame, pred_long: DataFrame, keys: Sequence[str] = ("UID", "dimension"), order: str = PLACE) -> DataFrame:
    """Participant rows meet gold rows on the key, not by position; every
    gold row stays once, with the first of the participant's rows of its key;
    ``matched`` is false where there is none, ``n_duplicates`` counts the others."""
    values = [c for c in pred_long.columns if c not in (*keys, order)]
    rows = _ordered(pred_long, values, order)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(order)).alias("_first"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    j = gold_long.join(best.withColumn("matched", F.lit(True)), list(keys), "left")
    return j.select(*gold_long.columns, *[F.col("_first")[v].alias(v) for v in values], F.coalesce("matched", F.lit(False)).alias("matched"),
                    F.coalesce("n_duplicates", F.lit(0)).cast("long").alias("n_duplicates"))


def merge_quality_files(files: dict[str, DataFrame], uid: str = "UID") -> DataFrame:
    """Combine per-quality files ``(UID, value)`` into one submission;
    ``complete`` is false where a file lacks the row (the reference asserts
    identical UID columns). Every row of every file stays: the k-th row of a
    UID in one file, by its place, meets the k-th of that UID in the others.

    The files are stacked, numbered and folded once, whatever their number."""
    parts = []
    for i, (dim, df) in enumerate(files.items()):
        value = next(c for c in df.columns if c not in (uid, PLACE))
        rows, _ = placed(df.select(F.col(uid), F.col(value).alias("_v"), *[PLACE] * (PLACE in df.columns)))
        parts.append(rows.select(uid, F.lit(i).alias("_file_no"), "_v", PLACE))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    long = occurrence(long, [uid, "_file_no"])
    own = {dim: F.col("_file_no") == i for i, dim in enumerate(files)}
    out = long.groupBy(uid, "_nth").agg(*[F.max(F.when(c, F.col("_v"))).alias(d) for d, c in own.items()],
                                        (F.count_distinct("_file_no") == len(files)).alias("complete"))
    return out.select(uid, *files, "complete")


def submission_checks(merged: DataFrame, expected_rows: int = SUBMISSION_ROWS, uid: str = "UID") -> DataFrame:
    """One-row check table: rows, UIDs that occur more than once, UIDs
    that some file lacks and whether everything holds (``expected_rows`` is a
    parameter)."""
    per_uid = merged.groupBy(uid).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("complete").cast("int")).alias("_c"))
    return per_uid.agg(
        F.sum("_n").alias("n_rows"),
        F.count_if(F.col("_n") > 1).alias("n_duplicate_uids"),
        F.count_if(F.col("_c") == 0).alias("n_incomplete"),
    ).select(
        "*",
        F.lit(expected_rows).cast("long").alias("expected_rows"),
        ((F.col("n_rows") == expected_rows) & (F.col("n_duplicate_uids") == 0) & (F.col("n_incomplete") == 0)).alias(
            "ok"
        ),
    )


def uid_difference(a: DataFrame, b: DataFrame, uid: str = "UID") -> DataFrame:
    """UIDs in one file but not the other (multiset ``exceptAll`` both
    ways); empty when the files agree."""
    x, y = a.select(uid), b.select(uid)
    return x.exceptAll(y).select(F.lit("left_only").alias("side"), uid).unionByName(
        y.exceptAll(x).select(F.lit("right_only").alias("side"), uid)
    )


def union_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """Append several train sets (UNION ALL; duplicates stay; missing
    columns become NULL) with a ``dataset`` column."""
    out = None
    for name, df in parts.items():
        d = df.withColumn("dataset", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def text_digest(text: str) -> Column:
    """32 bytes that stand for a whole text (SHA-256); NULL for NULL."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def drop_banned_contexts(train: DataFrame, dev: DataFrame, context: str = "context") -> DataFrame:
    """Remove train rows whose (raw) context occurs in the dev set
    (``left_anti``, never ``NOT IN``, for NULL safety).

    Contexts are long, so none is shuffled: both sides' distinct digests meet
    first, and what they share, the banned digests that train really holds, is
    written once (a job when this is called). It is as small as the overlap, so
    its known size lets the planner broadcast it and leave the train rows where
    they are; a large overlap is joined by digest, with skew splitting."""
    own, other = (d.select(text_digest(context).alias("_digest")).where("_digest is not null").distinct() for d in (train, dev))
    banned, _ = written(own.join(other, "_digest", "left_semi"))
    return train.withColumn("_digest", text_digest(context)).join(banned, "_digest", "left_anti").select(*train.columns)


def cap_rows(df: DataFrame, n: int, order: Sequence[str] = ("uid",)) -> DataFrame:
    """The first ``n`` rows by id, applied after the history is built so
    contexts stay complete."""
    return df.orderBy(*order).limit(n)
