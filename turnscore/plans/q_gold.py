"""Registered rating and grading queries: A1, A2, A5, A7, A9, A10, A16, A17,
S4, E3."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.operators import agreement as ag
from turnscore.operators import gold as gd
from turnscore.plans.oracle import avg_rank_sql, corr_sql, sql
from turnscore.plans.q_aggs import _MASKED, _RANKED
from turnscore.plans.registry import query
from turnscore.schemas import QUALITIES, TURN_DIMENSIONS
from turnscore.sources import adapters as ad
from turnscore.sources import catalogue as cg

# ------------------------------------------------------------------ A1 / A2 / A9 / S4

_A1 = """SELECT dialogue_id, dataset, annotation, rule,
       CASE WHEN rule = 'first' THEN ratings[1] ELSE list_sum(ratings) / nullif(len(ratings), 0) END AS value
FROM alists"""
_A1_ROWS = _A1.replace("SELECT dialogue_id,", "SELECT rid, dialogue_id, model,").replace("FROM alists", "FROM alists2")
_A2 = """SELECT j.dialogue_id, j.model, j.dataset, j.quality,
       CASE WHEN count(j.value) = count(*) AND count(*) = max(ns.n_src) THEN sum(j.weight * j.value) / sum(j.weight) END
         AS gold
FROM (SELECT v.rid, v.dialogue_id, v.model, v.dataset, m.quality, m.weight, v.value FROM a1 v
      JOIN qmap m ON m.dataset = v.dataset AND m.source = v.annotation) j
JOIN (SELECT dataset, quality, count(*) AS n_src FROM qmap GROUP BY dataset, quality) ns
  ON ns.dataset = j.dataset AND ns.quality = j.quality
GROUP BY j.rid, j.dialogue_id, j.model, j.dataset, j.quality"""


def _values(spark, sf_dir):
    return gd.annotator_aggregate(ad.annotation_lists(spark, sf_dir))


@query(
    "A1_annotator_aggregate",
    sql("SELECT dialogue_id, annotation, round(value, 6) AS value FROM a1", "alists", extra={"a1": _A1}),
)
def a1(spark, sf_dir):
    return _values(spark, sf_dir).select("dialogue_id", "annotation", "value")


def _gold(spark, sf_dir):
    """Gold of every dataset row, those that share an id or all values included."""
    rows = ad.annotation_maps(spark, sf_dir)
    values = F.transform_values("ratings", lambda k, v: gd.aggregate_ratings(v, F.col("rule")))
    return gd.composite_rows(rows.withColumn("values", values), keep=("dialogue_id", "model"))


@query(
    "A2_composite_quality",
    sql("SELECT dialogue_id, model, dataset, quality, round(gold, 6) AS gold FROM a2", "alists2", "qmap",
        extra={"a1": _A1_ROWS, "a2": _A2}),
)
def a2(spark, sf_dir):
    return _gold(spark, sf_dir)


_Q_ARR = ", ".join(f"'{q}'" for q in QUALITIES)


@query(
    "A9_label_coverage",
    sql(
        f"""SELECT r.dataset, q.quality, coalesce(m.mapped, false) AS mapped, r.n_rows,
       r.n_rows - coalesce(h.n_gold, 0) AS n_missing
FROM (SELECT dataset, count(*) AS n_rows FROM arows GROUP BY dataset) r
CROSS JOIN (SELECT unnest([{_Q_ARR}]) AS quality) q
LEFT JOIN (SELECT DISTINCT dataset, quality, true AS mapped FROM qmap) m ON m.dataset = r.dataset AND m.quality = q.quality
LEFT JOIN (SELECT dataset, quality, count(gold) AS n_gold FROM a2 GROUP BY dataset, quality) h
  ON h.dataset = r.dataset AND h.quality = q.quality""",
        "alists2", "qmap", extra={"a1": _A1_ROWS, "a2": _A2},
    ),
)
def a9(spark, sf_dir):
    rows = ad.annotation_maps(spark, sf_dir).select("dataset")
    return gd.label_coverage(spark, _gold(spark, sf_dir), rows, QUALITIES)


@query(
    "S4_dataset_catalogue",
    sql(
        """SELECT c.dataset, c.rule, c.path, c.n_annotations, r.n_rows,
       (SELECT count(DISTINCT quality) FROM qmap m WHERE m.dataset = c.dataset) AS n_qualities
FROM (SELECT DISTINCT dataset, rule, path, n_annotations FROM cat) c
JOIN (SELECT dataset, count(*) AS n_rows FROM drows GROUP BY dataset) r ON r.dataset = c.dataset""",
        "cat", "qmap", "drows",
    ),
)
def s4(spark, sf_dir):
    """Resolve each dataset present in the data through the catalogue: its
    aggregation rule, file path, annotation count and mapped qualities."""
    cat = cg.catalogue(spark).select("dataset", "rule", "path", "n_annotations").distinct()
    nq = cg.quality_mapping(spark).groupBy("dataset").agg(F.countDistinct("quality").alias("n_qualities"))
    rows = ad.dialogue_keys(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    meta = cat.join(nq, "dataset", "left").select(
        "dataset", "rule", "path", "n_annotations", F.coalesce("n_qualities", F.lit(0)).alias("n_qualities")
    )
    return rows.join(F.broadcast(meta), "dataset").select(
        "dataset", "rule", "path", "n_annotations", "n_rows", "n_qualities"
    )


# ------------------------------------------------------------------ A5 / A7 / E3 / A10 / A16 / A17


def _p_sql(r: str) -> str:
    """Two-sided p of a correlation: with whole degrees of freedom v = n - 2
    Student's tail is a finite sum in 1 - r*r."""
    even = (f"abs({r}) * list_sum(list_transform(range(v // 2), lambda k: "
            f"exp(lgamma(2*k + 1) - 2*lgamma(k + 1) - 2*k*ln(2.0) + k*ln(1 - {r}*{r}))))")
    odd = (f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r}*{r}) * coalesce(list_sum(list_transform(range((v - 1) // 2), "
           f"lambda k: exp(2*k*ln(2.0) + 2*lgamma(k + 1) - lgamma(2*k + 2) + k*ln(1 - {r}*{r})))), 0))")
    return f"CASE WHEN v >= 1 THEN round(1 - CASE WHEN v % 2 = 0 THEN {even} ELSE {odd} END, 6) END"


@query("A5_corr_pvalue", sql(
    f"""SELECT quality, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman,
       {_p_sql('pearson')} AS pearson_p, {_p_sql('spearman')} AS spearman_p FROM c""",
    "rl",
    extra={"m": _MASKED, "r": _RANKED,
           "c": f"SELECT quality, count(*) AS n, count(*) - 2 AS v, {corr_sql('gold', 'score')} AS pearson, "
                f"{corr_sql('gr', 'pr')} AS spearman FROM r GROUP BY quality"},
))
def a5(spark, sf_dir):
    """Two-sided p-values of r and rho per quality (pandas UDF on the
    4-row result)."""
    from turnscore.plans.q_aggs import per_quality

    return ag.with_pvalues(per_quality(spark, sf_dir))


_SLICES = """SELECT "UID", s.slice, "APPROPRIATENESS", "CONTENT_RICHNESS", "GRAMMATICAL_CORRECTNESS", "RELEVANCE"
FROM gold_wide, (SELECT unnest(['ALL', 'CID=' || "CID", 'SUPERVISED=' || "SUPERVISED"]) AS slice) s
WHERE "SID" = 'Chatbot'"""
_SL_LONG = " UNION ALL ".join(
    f"""SELECT "UID", slice, '{d}' AS dimension, "{d}" AS gold FROM sl""" for d in TURN_DIMENSIONS
)
_SUB_LONG = " UNION ALL ".join(f"""SELECT "UID", '{d}' AS dimension, "{d}" AS pred, n_duplicates FROM subfirst"""
                               for d in TURN_DIMENSIONS)
_PAIRS = """SELECT g."UID", g.slice, g.dimension, g.gold, p.pred, coalesce(p.n_duplicates, 0) AS n_duplicates FROM gl g LEFT JOIN pl p
  ON p."UID" = g."UID" AND p.dimension = g.dimension"""
_RK = f"""SELECT slice, dimension, gold, pred,
       {avg_rank_sql('gold', 'slice, dimension')} AS gr, {avg_rank_sql('pred', 'slice, dimension')} AS pr
FROM pairs WHERE gold IS NOT NULL AND NOT isnan(gold) AND pred IS NOT NULL AND NOT isnan(pred)"""


@query(
    "A7_leaderboard",
    sql(
        f"""SELECT u.slice, u.dimension, coalesce(c.n, 0) AS n, u.n_missing, u.n_duplicates, round(abs(c.spearman), 6) AS spearman,
       round(abs(c.pearson), 6) AS pearson
FROM (SELECT slice, dimension, count(*) FILTER (WHERE gold IS NOT NULL AND pred IS NULL) AS n_missing,
             CAST(sum(n_duplicates) AS BIGINT) AS n_duplicates
      FROM pairs GROUP BY slice, dimension) u
LEFT JOIN (SELECT slice, dimension, count(*) AS n, {corr_sql('gr', 'pr')} AS spearman,
                  {corr_sql('gold', 'pred')} AS pearson FROM rk GROUP BY slice, dimension) c
  ON c.slice = u.slice AND c.dimension = u.dimension""",
        "gold_wide", "subfirst",
        extra={"sl": _SLICES, "gl": _SL_LONG, "pl": _SUB_LONG, "pairs": _PAIRS, "rk": _RK},
    ),
)
def a7(spark, sf_dir):
    """Grade the submission on every slice in one job."""
    return ag.leaderboard_slices(ad.turn_gold_wide(spark, sf_dir), ad.submission_rows(spark, sf_dir), "t2t")


_E3_RK = f"""SELECT dimension, gold, pred, {avg_rank_sql('gold', 'dimension')} AS gr,
       {avg_rank_sql('pred', 'dimension')} AS pr
FROM pairs WHERE slice = 'CID=DS2' AND gold IS NOT NULL AND NOT isnan(gold) AND pred IS NOT NULL"""


@query(
    "E3_grade_submission",
    sql(
        f"""SELECT d.dimension, coalesce(c.n, 0) AS n, (SELECT count(*) FROM pairs p WHERE p.slice = 'CID=DS2'
         AND p.dimension = d.dimension AND p.gold IS NOT NULL AND p.pred IS NULL) AS n_missing,
       (SELECT CAST(sum(n_duplicates) AS BIGINT) FROM pairs p WHERE p.slice = 'CID=DS2' AND p.dimension = d.dimension) AS n_duplicates, round(abs(c.spearman), 6) AS spearman,
       round(abs(c.pearson), 6) AS pearson
FROM (SELECT unnest(['APPROPRIATENESS', 'RELEVANCE']) AS dimension) d
LEFT JOIN (SELECT dimension, count(*) AS n, {corr_sql('gr', 'pr')} AS spearman, {corr_sql('gold', 'pred')} AS pearson
           FROM rk3 GROUP BY dimension) c ON c.dimension = d.dimension""",
        "gold_wide", "subfirst",
        extra={"sl": _SLICES, "gl": _SL_LONG, "pl": _SUB_LONG, "pairs": _PAIRS, "rk3": _E3_RK},
    ),
)
def e3(spark, sf_dir):
    """Whole job: task 2 turn level, dataset DS2, two dimensions."""
    from turnscore.plans.jobs import grade_submission

    return grade_submission(ad.turn_gold_wide(spark, sf_dir), ad.submission_rows(spark, sf_dir), "t2t",
                            dataset="DS2", limit_dims="APPROPRIATENESS,RELEVANCE")


_A10 = f"""SELECT pool, gold, score, {avg_rank_sql('gold', 'pool')} AS gr, {avg_rank_sql('score', 'pool')} AS pr
FROM (SELECT unnest(['POOL', lang]) AS pool, gold, score FROM labdocs)"""


@query(
    "A10_pooled_evaluation",
    sql(f"""SELECT pool, 'quality' AS quality, count(*) AS n, round({corr_sql('gold', 'score')}, 6) AS pearson,
       round({corr_sql('gr', 'pr')}, 6) AS spearman FROM p GROUP BY pool""", "labdocs", extra={"p": _A10}),
)
def a10(spark, sf_dir):
    """Pool the per-language sets of the labels x documents gold table
    (gold = quality label, predictor = length) and evaluate pool and sets."""
    d = ad.labelled_documents(spark, sf_dir).withColumn("quality", F.lit("quality"))
    return ag.pooled_evaluation(d, "lang")


@query(
    "A16_log_cosh",
    sql("""SELECT quality, count(*) AS n,
       round(avg(abs(score - gold) + ln(1 + exp(-2 * abs(score - gold))) - ln(2)), 6) AS log_cosh
FROM rl WHERE gold IS NOT NULL AND NOT isnan(gold) GROUP BY quality""", "rl"),
)
def a16(spark, sf_dir):
    return ag.log_cosh_loss(ad.scored_turns(spark, sf_dir), ["quality"])


def _bin_sql(x: str) -> str:
    return f"CASE WHEN {x} < 1 THEN -1 WHEN {x} > 5 THEN 32 ELSE least(31, CAST(floor(({x} - 1.0) / 4.0 * 32) AS INTEGER)) END"


@query(
    "A17_score_distribution",
    sql(
        f"""SELECT quality, kind, gold_bin, pred_bin, count(*) AS n FROM (
  SELECT quality, 'gold' AS kind, {_bin_sql('gold')} AS gold_bin, NULL::INTEGER AS pred_bin FROM rl
    WHERE gold IS NOT NULL AND NOT isnan(gold)
  UNION ALL SELECT quality, 'pred', NULL::INTEGER, {_bin_sql('score')} FROM rl WHERE score IS NOT NULL
  UNION ALL SELECT quality, 'joint', {_bin_sql('gold')}, {_bin_sql('score')} FROM rl
    WHERE gold IS NOT NULL AND NOT isnan(gold) AND score IS NOT NULL)
GROUP BY quality, kind, gold_bin, pred_bin""",
        "rl",
    ),
)
def a17(spark, sf_dir):
    return ag.score_distribution(ad.scored_turns(spark, sf_dir), ["quality"])
