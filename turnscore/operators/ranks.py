"""W3_average_rank and W4_metric_vs_gold.

Average-tie ranks (scipy's ``rankdata`` default) computed without an
unpartitioned window:

1. ``groupBy(group, value)`` with a count: ties collapse, map-side combined, so
   a hot value or a hot group costs one row per task, not a hot task.
2. The distinct ``(group, value)`` rows are cut into ranges of their common
   order by sampled bounds: those rows whose hash falls on a fixed remainder.
   The sample spreads over the rows as they are, however narrow a range their
   values crowd, and being a pure function of the rows it is the same when a
   task is recomputed. The bounds are read once, sorted, and travel inside the
   plan as one literal (at most about ``MOST_BOUNDS``); every row finds its
   range by binary search.
3. Rows below a value = rows of the group in earlier ranges (a prefix sum over
   ranges) + rows below it inside its range (a window over that range).
4. ``rank = below + (count + 1) / 2``, joined back on ``(group, value)``; the
   rank table has one row per distinct value, so it is broadcast when it is
   small (ratings) and shuffled with skew-join splitting otherwise.

How many rows there are is observed while the counts are written; up to
``PER_RANGE`` of them no bounds are needed and each group is one window.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscore.operators.identity import written

#: Distinct rows that a range should hold, and the most bounds that are drawn (about).
PER_RANGE = 1 << 16
MOST_BOUNDS = 1 << 14
_ALL = "_rank_all"


def value_counts(df: DataFrame, value: str, group: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct ``(group..., value)`` rows with ``_cnt``; NULLs don't count.
    ``weight``: a row stands for that many."""
    cnt = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(cnt.alias("_cnt"))


def sampled_bounds(counts: DataFrame, keys: Sequence[str], n: int, per_range: int = PER_RANGE) -> Column | None:
    """The sorted bounds as a literal array of structs; None where ``n`` rows need none."""
    if n <= per_range:
        return None
    every = max(per_range, n // MOST_BOUNDS)
    drawn = counts.where(F.pmod(F.xxhash64(F.lit("bound"), *keys), F.lit(every)) == 0).select(*keys)
    # as JSON text, one constant for the optimizer instead of a tree of thousands
    rows = drawn.orderBy(*keys).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("j")).collect()
    if not rows:
        return None
    of = T.ArrayType(T.StructType([T.StructField(k, drawn.schema[k].dataType) for k in keys]))
    return F.from_json(F.lit("[" + ",".join(r["j"] for r in rows) + "]"), of.json())


def range_of(bounds: Column | None, keys: Sequence[str]) -> Column:
    """How many bounds are not above a row's keys, by binary search."""
    if bounds is None:
        return F.lit(0)
    own = F.struct(*keys)
    steps = F.lit([1 << i for i in range(MOST_BOUNDS.bit_length() + 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= own, at + step).otherwise(at))


def ranked_values(
    counts: DataFrame, value: str, group: Sequence[str], n: int, rank_col: str = "rank", per_range: int = PER_RANGE, centred: bool = False,
) -> DataFrame:
    """``(group..., value, rank_col)`` of ``value_counts`` with ``n`` rows.
    ``centred``: also ``_c_value`` and ``_c_rank``, value and rank less the
    group's means, and ``_varies``, whether the group has two values."""
    g = list(group)
    keys = [*g, value]
    bounds = sampled_bounds(counts, keys, n, per_range)
    weighted = F.col("_cnt") * F.col(value) if centred else F.lit(0.0)
    rows = counts.select(*keys, "_cnt", weighted.alias("_cv"), range_of(bounds, keys).alias("_range"))
    inside = Window.partitionBy(*g, "_range")
    rows = rows.withColumn("_below", F.coalesce(F.sum("_cnt").over(inside.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = {"_n": F.sum("_cnt"), "_sum": F.sum("_cv"), "_lo": F.min(value), "_hi": F.max(value)}
    if bounds is None:
        rows = rows.select("*", F.lit(0).alias("_off"), *[c.over(inside).alias(k) for k, c in whole.items()] * centred)
    else:
        # rows lie by range already, so the totals need no exchange; a group has at most a row per range
        totals = rows.groupBy(*g, "_range").agg(*[c.alias(k) for k, c in whole.items()])
        before = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        over = Window.partitionBy(*g)
        more = {"_n": F.sum("_n"), "_sum": F.sum("_sum"), "_lo": F.min("_lo"), "_hi": F.max("_hi")}
        totals = totals.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(g)], F.col("_range").alias("_of"),
                               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *[c.over(over).alias(k) for k, c in more.items()])
        same = F.col("_range") == F.col("_of")
        for i, k in enumerate(g):
            same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        rows = rows.join(totals, same)
    rank = F.col("_off") + F.col("_below") + (F.col("_cnt") + 1) / 2.0
    if not centred:
        return rows.select(*keys, rank.alias(rank_col))
    # average ranks have the mean (n + 1) / 2 whatever the ties
    return rows.select(
        *keys, rank.alias(rank_col), (F.col(value) - F.col("_sum") / F.col("_n")).alias("_c_value"),
        (rank - (F.col("_n") + 1) / 2.0).alias("_c_rank"), (F.col("_lo") < F.col("_hi")).alias("_varies"),
    )


def rank_table(
    df: DataFrame, value: str, group: Sequence[str] = (), rank_col: str = "rank", per_range: int = PER_RANGE, weight: str | None = None,
) -> DataFrame:
    """Distinct ``(group..., value, rank_col)`` rows with average-tie ranks. The
    counts are written once (a job when this is called)."""
    g = list(group) or [_ALL]
    src = df if group else df.withColumn(_ALL, F.lit(0))
    counts, seen = written(value_counts(src, value, g, weight), n=F.count(F.lit(1)))
    out = ranked_values(counts, value, g, seen["n"], rank_col, per_range)
    return out if group else out.drop(_ALL)


def average_rank(
    df: DataFrame, value: str, group: Sequence[str] = (), rank_col: str = "rank", per_range: int = PER_RANGE
) -> DataFrame:
    """Add ``rank_col`` = average-tie rank of ``value`` within ``group``
    (1-based). NULL values get a NULL rank and do not count."""
    ranks = rank_table(df, value, group, rank_col, per_range)
    if not group:
        return df.join(ranks, value, "left")
    names = {c: f"_r{i}" for i, c in enumerate([*group, value])}
    same = F.lit(True)
    for c, own in names.items():
        same = same & (F.col(c).eqNullSafe(F.col(own)) if c != value else F.col(c) == F.col(own))
    return df.join(ranks.withColumnsRenamed(names), same, "left").drop(*names.values())


def metric_vs_gold(
    df: DataFrame, id_col: str, gold: str, metric: str, per_range: int = PER_RANGE, group: Sequence[str] = ()
) -> DataFrame:
    """One metric against one gold column over the whole table, or within
    each ``group``: both ranks and the absolute rank difference, largest
    difference first (ties by id)."""
    base = df.select(*group, id_col, F.col(gold).alias("gold_score"), F.col(metric).alias("metric_score"))
    r = average_rank(base, "gold_score", group, "gold_rank", per_range)
    r = average_rank(r, "metric_score", group, "metric_rank", per_range)
    out = r.select(
        *group, id_col, "gold_score", "gold_rank", "metric_score", "metric_rank",
        F.abs(F.col("gold_rank") - F.col("metric_rank")).alias("metric_vs_gold"),
    )
    return out.orderBy(*group, F.col("metric_vs_gold").desc(), F.col(id_col))
