"""Registered aggregation queries."""

from __future__ import annotations

from turnscore.operators import agreement as ag
from turnscore.plans.oracle import avg_rank_sql, corr_sql, sql
from turnscore.plans.registry import query
from turnscore.sources import adapters as ad

_MASKED = """SELECT quality, gold, score FROM rl
WHERE gold IS NOT NULL AND NOT isnan(gold) AND score IS NOT NULL AND NOT isnan(score)"""
_RANKED = f"""SELECT quality, gold, score, {avg_rank_sql('gold', 'quality')} AS gr,
       {avg_rank_sql('score', 'quality')} AS pr FROM m"""


def scored_pairs(spark, sf_dir):
    """Gold and score of every turn (the slices are for grading, A7 and E3)."""
    return ad.scored_turns(spark, sf_dir)


def per_quality(spark, sf_dir):
    return ag.correlations(scored_pairs(spark, sf_dir), ["quality"], "gold", "score")


@query(
    "A3_pearson",
    sql(f"SELECT quality, count(*) AS n, round({corr_sql('gold', 'score')}, 6) AS pearson FROM m GROUP BY quality",
        "rl", extra={"m": _MASKED}),
)
def a3_pearson(spark, sf_dir):
    """Pearson r of gold vs score per quality, all turns, annotated pairs."""
    return ag.pearson(scored_pairs(spark, sf_dir), ["quality"], "gold", "score")


@query(
    "A4_spearman",
    sql(f"SELECT quality, count(*) AS n, round({corr_sql('gr', 'pr')}, 6) AS spearman FROM r GROUP BY quality",
        "rl", extra={"m": _MASKED, "r": _RANKED}),
)
def a4_spearman(spark, sf_dir):
    """Spearman rho (Pearson over average-tie ranks) per quality."""
    return per_quality(spark, sf_dir).select("quality", "n", "spearman")


@query(
    "A6_macro_mean",
    sql(
        """SELECT count(*) AS n_qualities,
       count(*) FILTER (WHERE pearson IS NULL OR spearman IS NULL) AS n_undefined,
       round(avg(pearson), 6) AS pearson_mean, round(avg(spearman), 6) AS spearman_mean FROM c""",
        "rl",
        extra={
            "m": _MASKED,
            "r": _RANKED,
            "c": f"SELECT quality, {corr_sql('gold', 'score')} AS pearson, {corr_sql('gr', 'pr')} AS spearman "
                 "FROM r GROUP BY quality",
        },
    ),
)
def a6_macro_mean(spark, sf_dir):
    """Mean r and rho over the evaluated qualities."""
    return ag.macro_mean(per_quality(spark, sf_dir))
