"""Agreement of scores with human ratings: P8, P9, P10, A3-A7, A10, A16, A17.

All correlations are grouped aggregates (partial aggregation, so a hot group
is pre-aggregated per partition before the shuffle). Spearman is Pearson over
average-tie ranks from :mod:`turnscore.operators.ranks`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.functions.stats import pvalue
from turnscore.operators.identity import written
from turnscore.operators.ranks import PER_RANGE, ranked_values, value_counts
from turnscore.operators.submissions import first_per_uid
from turnscore.schemas import SUBTASK_DIMENSIONS


def present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def annotated_mask(df: DataFrame, gold: str = "gold") -> DataFrame:
    """Keep rows whose gold is present (not NULL, not NaN)."""
    return df.where(present(gold))


def paired_mask(df: DataFrame, gold: str = "gold", pred: str = "score") -> DataFrame:
    """P9 applied pairwise: gold and prediction both present."""
    return df.where(present(gold) & present(pred))


def mask_report(df: DataFrame, group: Sequence[str], gold: str = "gold", pred: str = "score") -> DataFrame:
    """Rows per group, rows with gold, and rows dropped for a missing prediction."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(present(gold)).alias("n_gold"),
        F.count_if(present(gold) & ~present(pred)).alias("n_dropped_pred"),
    )


def pearson(df: DataFrame, group: Sequence[str], gold: str = "gold", pred: str = "score") -> DataFrame:
    """A3 alone: ``group..., n, pearson`` in one aggregate and one exchange. The
    built-in (co)variances carry mergeable means and co-moments, so partial
    results of tasks merge without loss of digits far from zero. Masks and
    NULLs as in :func:`correlations`."""
    ok = present(gold) & present(pred)
    rows = df.select(*group, F.when(ok, F.col(gold).cast("double")).alias("_x"), F.when(ok, F.col(pred).cast("double")).alias("_y"))
    agg = rows.groupBy(*group).agg(
        F.count("_x").alias("n"), F.covar_pop("_x", "_y").alias("_xy"), F.var_pop("_x").alias("_xx"), F.var_pop("_y").alias("_yy"),
        F.expr("min(_x) < max(_x) AND min(_y) < max(_y)").alias("_varies"),
    )
    return agg.select(*group, "n", _corr("_varies", "_xx", "_yy", "_xy").alias("pearson"))


def _corr(varies: str, xx: str, yy: str, xy: str) -> Column:
    return F.expr(f"CASE WHEN {varies} AND {xx} > 0 AND {yy} > 0 THEN greatest(-1.0D, least(1.0D, {xy} / (sqrt({xx}) * sqrt({yy})))) END")


def correlations(
    df: DataFrame, group: Sequence[str], gold: str = "gold", pred: str = "score", per_range: int = PER_RANGE,
    missing: bool = False, sums: Sequence[str] = (),
) -> DataFrame:
    """A3 + A4 per group: ``group..., n, pearson, spearman`` and, with
    ``missing``, ``n_missing``, the annotated rows that have no prediction;
    ``sums`` names counts (columns) that are added up beside.

    Pairs where gold or prediction is missing (NULL / NaN) are masked out
    (P9, pairwise); a group with no pair is kept with ``n = 0`` and NULL
    correlations; a constant column gives NULL (exactly: ``min = max``).

    The rows are read once and collapsed to distinct ``(group, gold, pred)``
    pairs with a count (map-side combined: ratings against parsed scores
    collapse to a few rows per group, and a hot group costs one row per value
    pair and task). That weighted table is written once, in the shared
    checkpoint folder; all else reads it. Each side's distinct values get their
    ranks (:mod:`turnscore.operators.ranks`), and with them value and rank less
    their group's means, which are known by then: the final sums are of centred
    products, in one aggregate, and cannot cancel."""
    g = list(group)
    ok = present(gold) & present(pred)
    lost = present(gold) & ~F.coalesce(present(pred), F.lit(False))
    pairs = df.select(*g, F.when(ok, F.col(gold).cast("double")).alias("_x"), F.when(ok, F.col(pred).cast("double")).alias("_y"),
                      lost.cast("long").alias("_l"), *sums)
    pairs = pairs.groupBy(*g, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"), F.sum("_l").alias("_l"), *[F.sum(c).alias(c) for c in sums])
    pairs, seen = written(pairs, n=F.count(F.lit(1)))
    j = pairs
    for side in ("_x", "_y"):
        ranked = ranked_values(value_counts(pairs, side, g, "_c"), side, g, seen["n"], "_rank", per_range, centred=True)
        names = {c: f"{side}{i}" for i, c in enumerate([*g, side])} | {"_rank": f"{side}_rank", "_c_value": f"{side}v", "_c_rank": f"{side}r", "_varies": f"{side}s"}
        ranked = ranked.withColumnsRenamed(names)
        same = F.col(side) == F.col(names[side])
        for c in g:
            same = same & F.col(c).eqNullSafe(F.col(names[c]))
        j = j.join(ranked, same, "left").drop(*[names[c] for c in (*g, side)])
    # the means were rounded: what the centred values still add up to is taken off (for ranks it is 0)
    moments = {"_sx": "_xv", "_sy": "_yv", "_xx": "_xv * _xv", "_yy": "_yv * _yv", "_xy": "_xv * _yv", "_rxx": "_xr * _xr", "_ryy": "_yr * _yr", "_rxy": "_xr * _yr"}
    agg = j.groupBy(*g).agg(
        F.expr("coalesce(sum(CASE WHEN _x IS NOT NULL THEN _c END), 0)").alias("n"), F.sum("_l").alias("n_missing"),
        F.expr("coalesce(bool_or(_xs), false) AND coalesce(bool_or(_ys), false)").alias("_varies"),
        *[F.expr(f"sum(_c * {e})").alias(k) for k, e in moments.items()], *[F.sum(c).alias(c) for c in sums],
    )
    return agg.select(
        *g, "n", *["n_missing"] * missing, *sums,
        _corr("_varies", "(_xx - try_divide(_sx * _sx, n))", "(_yy - try_divide(_sy * _sy, n))", "(_xy - try_divide(_sx * _sy, n))").alias("pearson"),
        _corr("_varies", "_rxx", "_ryy", "_rxy").alias("spearman"))


def macro_mean(per_quality: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean of r and rho over the evaluated qualities; undefined (NULL)
    correlations are skipped and counted; no quality gives NULL."""
    return per_quality.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_qualities"),
        F.count_if(F.col("pearson").isNull() | F.col("spearman").isNull()).alias("n_undefined"),
        F.avg("pearson").alias("pearson_mean"),
        F.avg("spearman").alias("spearman_mean"),
    )


def with_pvalues(corr: DataFrame, n_col: str = "n", cols: Sequence[str] = ("pearson", "spearman")) -> DataFrame:
    """A5: two-sided p-value of each correlation (t-test with n-2 degrees of
    freedom, as scipy), column expressions only."""
    return corr.withColumns({f"{c}_p": pvalue(F.col(c), F.col(n_col)) for c in cols})


def eval_slice(
    gold: DataFrame,
    subtask: str = "t2t",
    dataset: str | None = None,
    language: str | None = None,
    supervised: str | None = None,
) -> DataFrame:
    """Chatbot turns for turn subtasks; optional dataset (CID), language
    (task 1 only) and supervision filters. Pushed down to Parquet."""
    out = gold
    if subtask in ("t1t", "t2t"):
        out = out.where(F.col("SID") == "Chatbot")
    if dataset:
        out = out.where(F.col("CID") == dataset)
    if language and subtask in ("t1t", "t1d"):
        out = out.where(F.col("LANGUAGE") == language)
    if supervised:
        out = out.where(F.col("SUPERVISED") == supervised)
    return out


def select_dimensions(subtask: str, limit_dims: str | Sequence[str] | None = None) -> list[str]:
    """P10: the subtask's four dimensions, optionally limited to a subset
    (which must be a subset), in the subtask's order."""
    dims = list(SUBTASK_DIMENSIONS[subtask])
    if limit_dims is None:
        return dims
    chosen = set(limit_dims.split(",")) if isinstance(limit_dims, str) else set(limit_dims)
    unknown = chosen - set(dims)
    if unknown:
        raise ValueError(f"dimensions {sorted(unknown)} not in {dims}")
    return [d for d in dims if d in chosen]


def dimension_table(spark: SparkSession, dims: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, d) for i, d in enumerate(dims)], "dim_order int, dimension string")


def _aligned_pairs(gold: DataFrame, submission: DataFrame, dims: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Gold and submission rows meet once, wide, on the UID; the
    dimensions fan out afterwards with ``inline`` (no join of long tables).
    Every gold row stays, with a NULL prediction where the submission lacks it.
    A UID that the submission repeats counts once, by its first row;
    ``n_duplicates`` says how many rows more there were."""
    sub = first_per_uid(submission, dims)
    sub = sub.select(F.col("UID"), *[F.col(d).alias(f"_p_{d}") for d in dims], "n_duplicates")
    j = gold.select("UID", *keep, *dims).join(sub, "UID", "left")
    arr = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("gold"),
                             F.col(f"_p_{d}").cast("double").alias("pred")) for d in dims])
    return j.select("UID", *keep, F.coalesce("n_duplicates", F.lit(0)).cast("long").alias("n_duplicates"), F.inline(arr))


def leaderboard(
    gold: DataFrame,
    submission: DataFrame,
    subtask: str = "t2t",
    dataset: str | None = None,
    language: str | None = None,
    supervised: str | None = None,
    limit_dims: str | Sequence[str] | None = None,
    per_range: int = PER_RANGE,
    strict: bool = False,
) -> DataFrame:
    """Grade a submission. Per dimension: ``|rho|`` and ``|r|`` of
    the submission against gold on the chosen slice; NULL where it cannot be
    computed (the reference prints ``-``). Aligned by UID (J2), not by row
    position, and one row per UID: a repeated UID counts once.

    ``n_missing`` counts the annotated gold rows that the submission lacks, so
    leaving out hard turns shows; ``n_duplicates`` the rows by which it repeats
    UIDs of the slice, so repeating easy ones does. ``strict`` raises on any
    (one small action)."""
    spark = gold.sparkSession
    dims = select_dimensions(subtask, limit_dims)
    pairs = _aligned_pairs(eval_slice(gold, subtask, dataset, language, supervised), submission, dims)
    if strict:
        lacks = present("gold") & ~F.coalesce(present("pred"), F.lit(False))
        found = pairs.groupBy("dimension").agg(F.count_if(lacks).alias("n"), F.sum("n_duplicates").alias("d")).collect()
        short = {r["dimension"]: r["n"] for r in found if r["n"]}
        if short:
            raise ValueError(f"the submission lacks annotated gold rows: {short}")
        if any(r["d"] for r in found):
            raise ValueError(f"the submission repeats UIDs: {max(r['d'] for r in found)} rows too many")
    corr = correlations(pairs, ["dimension"], "gold", "pred", per_range, missing=True, sums=["n_duplicates"])
    dt = F.broadcast(dimension_table(spark, dims))
    counts = ("n", "n_missing", "n_duplicates")
    return dt.join(corr, "dimension", "left").select(
        "dimension",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.abs("spearman").alias("spearman"),
        F.abs("pearson").alias("pearson"),
    )


def leaderboard_slices(
    gold: DataFrame, submission: DataFrame, subtask: str = "t2t", per_range: int = PER_RANGE
) -> DataFrame:
    """A7 for every slice in one job: each aligned row is exploded into the
    slices it belongs to (all, its dataset, its supervision flag and, for
    task 1, its language); ranks are slice-relative."""
    dims = select_dimensions(subtask)
    base = eval_slice(gold, subtask)
    members = [F.lit("ALL"), F.concat(F.lit("CID="), "CID"), F.concat(F.lit("SUPERVISED="), "SUPERVISED")]
    if subtask in ("t1t", "t1d"):
        members.append(F.concat(F.lit("LANGUAGE="), "LANGUAGE"))
    base = base.select("UID", F.array(*members).alias("_slices"), *dims)
    pairs = _aligned_pairs(base, submission, dims, ["_slices"])
    pairs = pairs.select(F.explode("_slices").alias("slice"), "dimension", "gold", "pred", "n_duplicates")
    corr = correlations(pairs, ["slice", "dimension"], "gold", "pred", per_range, missing=True, sums=["n_duplicates"])
    return corr.select(
        "slice", "dimension", "n", "n_missing", "n_duplicates", F.abs("spearman").alias("spearman"), F.abs("pearson").alias("pearson"))


def pooled_evaluation(
    df: DataFrame, set_col: str, gold: str = "gold", pred: str = "score", quality: str = "quality",
    pool_name: str = "POOL", per_range: int = PER_RANGE,
) -> DataFrame:
    """A10: pool several train sets and evaluate the pool once, plus each set
    on its own, in one job (each row belongs to the pool and to its set)."""
    rows = df.select(F.explode(F.array(F.lit(pool_name), F.col(set_col))).alias("pool"), quality, gold, pred)
    return correlations(rows, ["pool", quality], gold, pred, per_range)


def log_cosh(d: Column) -> Column:
    """Numerically stable ``log(cosh(d))``."""
    a = F.abs(d)
    return a + F.log1p(F.exp(-2 * a)) - F.lit(math.log(2.0))


def log_cosh_loss(df: DataFrame, group: Sequence[str], gold: str = "gold", pred: str = "score") -> DataFrame:
    """Mean log-cosh error per group over annotated pairs."""
    m = paired_mask(df, gold, pred)
    return m.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(log_cosh(F.col(pred) - F.col(gold))).alias("log_cosh")
    )


def bin_index(c: Column, lo: float, hi: float, n_bins: int) -> Column:
    """Equal-width bin of ``c`` over ``[lo, hi]`` (``hi`` is in the last bin);
    -1 below and ``n_bins`` above."""
    b = F.floor((c - F.lit(lo)) / F.lit(hi - lo) * n_bins).cast("int")
    return F.when(c < lo, -1).when(c > hi, n_bins).otherwise(F.least(F.lit(n_bins - 1), b))


def score_distribution(
    df: DataFrame, group: Sequence[str], gold: str = "gold", pred: str = "score",
    n_bins: int = 32, lo: float = 1.0, hi: float = 5.0,
) -> DataFrame:
    """Binned counts of gold and of predictions (1-D) and of the
    gold/prediction pairs (2-D), per group. ``kind`` is gold, pred or joint;
    bins -1 and ``n_bins`` hold what lies outside ``[lo, hi]``."""
    gb = F.when(present(gold), bin_index(F.col(gold), lo, hi, n_bins))
    pb = F.when(present(pred), bin_index(F.col(pred), lo, hi, n_bins))
    rows = df.select(*group, gb.alias("gold_bin"), pb.alias("pred_bin"))
    kinds = F.array(
        F.struct(F.lit("gold").alias("kind"), F.col("gold_bin").alias("gb"), F.lit(None).cast("int").alias("pb")),
        F.struct(F.lit("pred").alias("kind"), F.lit(None).cast("int").alias("gb"), F.col("pred_bin").alias("pb")),
        F.struct(F.lit("joint").alias("kind"), F.col("gold_bin").alias("gb"), F.col("pred_bin").alias("pb")),
    )
    x = rows.select(*group, F.inline(kinds))
    x = x.where(
        ((F.col("kind") == "gold") & F.col("gb").isNotNull())
        | ((F.col("kind") == "pred") & F.col("pb").isNotNull())
        | ((F.col("kind") == "joint") & F.col("gb").isNotNull() & F.col("pb").isNotNull())
    )
    return x.groupBy(*group, "kind", F.col("gb").alias("gold_bin"), F.col("pb").alias("pred_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
