"""Registered window and mining queries (SURVEY 2.5, 2.6 T1/T2, 2.3 J5/J7/J8,
2.4 A12/A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.operators import agreement as ag
from turnscore.operators import dialogues as dl
from turnscore.operators import mining as mn
from turnscore.operators.identity import PLACE
from turnscore.operators.ranks import average_rank, metric_vs_gold
from turnscore.plans.oracle import avg_rank_sql, sql, trim_ws_sql
from turnscore.plans.q_rows import _RUN_COLS, run_table
from turnscore.plans.registry import query
from turnscore.schemas import QUALITIES
from turnscore.sources import adapters as ad

# ------------------------------------------------------------------ W1 / W2


@query(
    "W1_dialogue_context",
    sql(
        f"""SELECT uid, coalesce(string_agg({trim_ws_sql('text')}, chr(10)) OVER (PARTITION BY dialogue_id
        ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
FROM turns WHERE NOT coalesce(ends_with(uid, '000'), false)""",
        "turns",
    ),
)
def w1(spark, sf_dir):
    """History of every kept turn (first turns dropped before, as at load)."""
    t = dl.drop_first_turns(ad.turns(spark, sf_dir))
    return dl.dialogue_context(t).select("uid", "context")


_W2_X = """SELECT id, response, string_split(id, '-')[2] AS dk, CAST(string_split(id, '-')[-1] AS BIGINT) AS tn,
       ends_with(string_split(id, '-')[-1], '0') AS is_first FROM rehearsal_in"""
_W2_S = """SELECT *, sum(CASE WHEN is_first THEN 1 ELSE 0 END) OVER (PARTITION BY dk ORDER BY tn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM x"""


@query(
    "W2_segment_context",
    sql(
        """SELECT id, CAST(segment AS BIGINT) AS segment, is_first,
       coalesce(string_agg(response, chr(10)) OVER (PARTITION BY dk, segment ORDER BY tn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM s""",
        "rehearsal_in",
        extra={"x": _W2_X, "s": _W2_S},
    ),
)
def w2(spark, sf_dir):
    r = ad.rehearsal_input(spark, sf_dir)
    x = r.select(
        "id", "response",
        F.get(F.split("id", "-", -1), 1).alias("dk"),
        F.substring_index("id", "-", -1).cast("long").alias("tn"),
        F.substring_index("id", "-", -1).alias("turn_last"),
    )
    s = dl.segment_context(x, dialogue="dk", turn="tn", turn_label="turn_last", text="response")
    return s.select("id", "segment", "is_first", "context")


# ------------------------------------------------------------------ W3 / W4


@query(
    "W3_average_rank",
    sql(f"""SELECT uid, quality, gold, {avg_rank_sql('gold', 'quality')} AS gold_rank
FROM rl WHERE gold IS NOT NULL AND NOT isnan(gold)""", "rl"),
)
def w3(spark, sf_dir):
    g = ag.annotated_mask(ad.scored_turns(spark, sf_dir)).select("uid", "quality", "gold")
    return average_rank(g, "gold", ["quality"], "gold_rank")


@query(
    "W4_metric_vs_gold",
    sql(
        f"""SELECT quality, uid, gold AS gold_score, {avg_rank_sql('gold', 'quality')} AS gold_rank, score AS metric_score,
       {avg_rank_sql('score', 'quality')} AS metric_rank,
       abs({avg_rank_sql('gold', 'quality')} - {avg_rank_sql('score', 'quality')}) AS metric_vs_gold
FROM rl WHERE gold IS NOT NULL AND NOT isnan(gold)""",
        "rl",
    ),
)
def w4(spark, sf_dir):
    g = ag.annotated_mask(ad.scored_turns(spark, sf_dir))
    return metric_vs_gold(g, "uid", "gold", "score", group=["quality"])


# ------------------------------------------------------------------ mining

_LONG = " UNION ALL ".join(
    [f"SELECT rid, dialogue_id, model, 'annotations.{q}' AS column_name, 'gold' AS role, \"annotations.{q}\" AS value FROM run"
     for q in QUALITIES]
    + [f"SELECT rid, dialogue_id, model, 'LLM_{q}', 'pred', LLM_{q} FROM run" for q in QUALITIES]
)
_RK = f"""SELECT *, CASE WHEN value IS NOT NULL THEN {avg_rank_sql('value', 'column_name')} END AS rank FROM lg"""
_J8 = """SELECT g.rid, g.dialogue_id, g.model, g.column_name AS gold_col, p.column_name AS pred_col,
       g.column_name || '_vs_' || p.column_name AS pair, abs(g.rank - p.rank) AS rank_diff
FROM rk g JOIN rk p ON g.rid = p.rid AND g.role = 'gold' AND p.role = 'pred'
     AND ends_with(p.column_name, substr(g.column_name, 13))"""
_GAP = "SELECT rid, dialogue_id, model, avg(rank_diff) AS mean_diff FROM j8 GROUP BY rid, dialogue_id, model"
_MINING = {"run": _RUN_COLS, "lg": _LONG, "rk": _RK, "j8": _J8, "gap": _GAP}
_HARD = """SELECT * FROM gap ORDER BY mean_diff DESC NULLS LAST, dialogue_id LIMIT 200"""


def _ranked(spark, sf_dir):
    run = run_table(spark, sf_dir)
    gold, pred = mn.discover_columns(run.columns, "LLM")
    return gold, pred, mn.row_ranks(run, gold, pred)


def _gaps(spark, sf_dir):
    return mn.rank_disagreement(run_table(spark, sf_dir), "LLM", ("dialogue_id", "model"))


@query(
    "J7_gold_pred_cross",
    sql(
        """SELECT g.dialogue_id, g.column_name AS gold_col, p.column_name AS pred_col,
       g.column_name || '_vs_' || p.column_name AS pair, round(abs(g.rank - p.rank), 6) AS rank_diff
FROM rk g JOIN rk p ON g.rid = p.rid AND g.role = 'gold' AND p.role = 'pred'""",
        "scores_wide", "gold_wide", extra={"run": _RUN_COLS, "lg": _LONG, "rk": _RK},
    ),
)
def j7(spark, sf_dir):
    gold, pred, ranked = _ranked(spark, sf_dir)
    return mn.rank_differences(ranked, [*gold, *pred], mn.cross_pairs(gold, pred)).drop(PLACE)


@query(
    "J8_gold_pred_suffix",
    sql("SELECT dialogue_id, gold_col, pred_col, pair, round(rank_diff, 6) AS rank_diff FROM j8",
        "scores_wide", "gold_wide", extra={"run": _RUN_COLS, "lg": _LONG, "rk": _RK, "j8": _J8}),
)
def j8(spark, sf_dir):
    gold, pred, ranked = _ranked(spark, sf_dir)
    pairs, _ = mn.suffix_pairs(gold, pred)
    return mn.rank_differences(ranked, [*gold, *pred], pairs).drop(PLACE)


@query(
    "A13_mean_rank_gap",
    sql("SELECT dialogue_id, round(mean_diff, 6) AS mean_diff FROM gap", "scores_wide", "gold_wide",
        extra=_MINING),
)
def a13(spark, sf_dir):
    return _gaps(spark, sf_dir).drop("model")


@query(
    "T1_sort_by_gap",
    sql("SELECT dialogue_id, round(mean_diff, 6) AS mean_diff FROM gap ORDER BY mean_diff DESC, dialogue_id",
        "scores_wide", "gold_wide", extra=_MINING),
)
def t1(spark, sf_dir):
    return mn.sort_by_gap(_gaps(spark, sf_dir).drop("model"))


@query(
    "T2_hardest_n",
    sql("SELECT dialogue_id, round(mean_diff, 6) AS mean_diff FROM (" + _HARD + ")",
        "scores_wide", "gold_wide", extra=_MINING),
)
def t2(spark, sf_dir):
    return mn.hardest(_gaps(spark, sf_dir).drop("model"), 200)


@query(
    "A12_source_share",
    sql(
        """SELECT h.model, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (""" + _HARD + """) h GROUP BY h.model""",
        "scores_wide", "gold_wide", extra=_MINING,
    ),
)
def a12(spark, sf_dir):
    return mn.source_share(mn.hardest(_gaps(spark, sf_dir), 200))


@query(
    "J5_hard_subset_semi",
    sql(
        """SELECT d.dialogue_id, d.dataset, d.model FROM drows d
WHERE d.dialogue_id IN (SELECT dialogue_id FROM (""" + _HARD + "))",
        "drows", "scores_wide", "gold_wide", extra=_MINING,
    ),
)
def j5(spark, sf_dir):
    gaps = _gaps(spark, sf_dir)
    d = ad.dialogue_rows(spark, sf_dir).select("dialogue_id", "dataset", "model")
    return mn.hard_subset(d, mn.hardest(gaps, 200))
