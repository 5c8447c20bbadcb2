"""Registered projection / filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.operators import agreement as ag
from turnscore.operators import dialogues as dl
from turnscore.operators import gold as gd
from turnscore.plans.oracle import NUM_RE, sql, trim_ws_sql  # noqa: F401
from turnscore.plans.registry import query
from turnscore.schemas import TURN_DIMENSIONS
from turnscore.sources import adapters as ad


@query(
    "P1_drop_first_turns",
    sql("SELECT uid, dialogue_id, turn_id, sid FROM turns WHERE NOT coalesce(ends_with(uid, '000'), false)",
        "turns"),
)
def p1(spark, sf_dir):
    return dl.drop_first_turns(ad.turns(spark, sf_dir)).select("uid", "dialogue_id", "turn_id", "sid")


@query(
    "P2_parse_uid",
    sql(
        """SELECT id AS uid, string_split(id, '-')[1] AS uid_prefix, string_split(id, '-')[2] AS uid_dialogue,
       string_split(id, '-')[3] AS uid_turn, string_split(id, '-')[-1] AS turn_last,
       (string_split(id, '-')[1] = 'TEST' AND len(string_split(id, '-')) = 3) AS prefix_ok
FROM (SELECT uid AS id FROM turns UNION ALL SELECT replace(uid, 'TEST-', 'DEV-') FROM turns WHERE turn_id = 1)""",
        "turns",
    ),
)
def p2(spark, sf_dir):
    t = ad.turns(spark, sf_dir)
    ids = t.select("uid").unionByName(
        t.where(F.col("turn_id") == 1).select(F.regexp_replace("uid", "TEST-", "DEV-").alias("uid"))
    )
    return ids.select("uid", *dl.parse_uid("uid"))


_VARIANTS = " UNION ALL ".join(
    f"SELECT dialogue_id, '{k}' AS lang, {c} AS context, {r} AS response FROM drows"
    for k, (c, r) in dl.LANG_COLUMNS.items()
)


@query("P3_language_variant", sql(_VARIANTS, "drows"))
def p3(spark, sf_dir):
    return dl.melt_variants(ad.dialogue_rows(spark, sf_dir))


@query(
    "P4_empty_response",
    sql("SELECT dialogue_id, CASE WHEN response = '' THEN 'no response' ELSE response END AS response FROM drows",
        "drows"),
)
def p4(spark, sf_dir):
    d = ad.dialogue_rows(spark, sf_dir)
    return d.select("dialogue_id", dl.empty_response("response").alias("response"))


@query(
    "P5_trim_and_role",
    sql(
        f"""SELECT dialogue_id, {trim_ws_sql('context_pa')} AS context,
       {trim_ws_sql("CASE WHEN response_pa = '' THEN 'no response' ELSE response_pa END")} AS response,
       'B: ' || {trim_ws_sql("CASE WHEN response = '' THEN 'no response' ELSE response END")} AS response_role
FROM drows""",
        "drows",
    ),
)
def p5(spark, sf_dir):
    d = ad.dialogue_rows(spark, sf_dir)
    c, r = dl.LANG_COLUMNS["par"]
    role = dl.prepare_pairs(d.withColumn("plain", F.col("response")), insert_speaker=True, response="plain")
    both = dl.prepare_pairs(role.withColumnRenamed("plain", "response_role"), context=c, response=r)
    return both.select("dialogue_id", F.col(c).alias("context"), F.col(r).alias("response"), "response_role")


def speaker_sql(x: str) -> str:
    return (
        f"array_to_string(list_reverse(list_transform(list_reverse(string_split({trim_ws_sql(x)}, chr(10))), "
        "lambda s, i: CASE WHEN (i - 1) % 2 = 0 THEN 'A: ' ELSE 'B: ' END || s)), chr(10))"
    )


@query("P6_speaker_tags", sql(f"SELECT dialogue_id, {speaker_sql('context')} AS context FROM drows", "drows"))
def p6(spark, sf_dir):
    d = ad.dialogue_rows(spark, sf_dir)
    return d.select("dialogue_id", dl.speaker_tags("context").alias("context"))


_P7 = " UNION ALL ".join(
    f"""SELECT "UID" AS uid, '{q}' AS quality, "{dim}" AS gold FROM gold_wide"""
    for dim, q in zip(TURN_DIMENSIONS, ("appropriateness", "richness", "grammatical", "relevance"))
)


@query("P7_quality_rename", sql(_P7, "gold_wide"))
def p7(spark, sf_dir):
    return gd.challenge_to_long(ad.turn_gold_wide(spark, sf_dir))


@query(
    "P8_eval_slice",
    sql("""SELECT "UID", "CID", "SID", "SUPERVISED" FROM gold_wide
WHERE "SID" = 'Chatbot' AND "CID" = 'DS1' AND "SUPERVISED" = 'NO'""", "gold_wide"),
)
def p8(spark, sf_dir):
    g = ag.eval_slice(ad.turn_gold_wide(spark, sf_dir), "t2t", dataset="DS1", language="EN", supervised="NO")
    return g.select("UID", "CID", "SID", "SUPERVISED")


@query(
    "P9_annotated_mask",
    sql("SELECT uid, quality, gold, score FROM rl WHERE gold IS NOT NULL AND NOT isnan(gold)", "rl"),
)
def p9(spark, sf_dir):
    return ag.annotated_mask(ad.scored_turns(spark, sf_dir)).select("uid", "quality", "gold", "score")


@query(
    "P10_select_dimensions",
    sql(
        """SELECT dimension, count(*) AS n, round(avg(v), 6) AS mean_score FROM (
  SELECT 'APPROPRIATENESS' AS dimension, "APPROPRIATENESS" AS v FROM submission
  UNION ALL SELECT 'RELEVANCE', "RELEVANCE" FROM submission) GROUP BY dimension""",
        "submission",
    ),
)
def p10(spark, sf_dir):
    dims = ag.select_dimensions("t2t", "RELEVANCE,APPROPRIATENESS")
    sub = ad.submission_wide(spark, sf_dir)
    long = sub.unpivot(["UID"], dims, "dimension", "v")
    return long.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_score"))


@query("P11_drop_unlabelled", sql("SELECT dialogue_id, gold FROM emb_records WHERE gold IS NOT NULL", "emb_records"))
def p11(spark, sf_dir):
    kept, _ = gd.drop_unlabelled(ad.embedding_records(spark, sf_dir), "gold")
    return kept.select("dialogue_id", "gold")


_RUN_BASE = """SELECT s.uid AS dialogue_id, 'model-' || CAST(s.dialogue_id % 5 AS VARCHAR) AS model,
       g."APPROPRIATENESS" AS "annotations.appropriateness", g."CONTENT_RICHNESS" AS "annotations.richness",
       g."GRAMMATICAL_CORRECTNESS" AS "annotations.grammatical", g."RELEVANCE" AS "annotations.relevance",
       s.appropriateness AS LLM_appropriateness, s.richness AS LLM_richness,
       s.grammatical AS LLM_grammatical, s.relevance AS LLM_relevance,
       (s.appropriateness + s.relevance) / 2 AS am_fm_scores, s.dialogue_id AS conv_id
FROM scores_wide s JOIN gold_wide g ON g."UID" = s.uid"""
# some rows stand twice, equal in all; of others a second row has its NULL elsewhere
_RUN_COLS = f"""SELECT *, row_number() OVER () AS rid FROM (
SELECT * EXCLUDE (conv_id, again) REPLACE (
         CASE WHEN again = 1 THEN NULL ELSE "annotations.appropriateness" END AS "annotations.appropriateness",
         CASE WHEN again = 1 THEN "annotations.appropriateness" WHEN again = 2 THEN NULL ELSE "annotations.relevance" END AS "annotations.relevance")
FROM (SELECT *, unnest(CASE WHEN conv_id % 13 = 0 THEN [0, 0] WHEN conv_id % 17 = 0 THEN [0, 1, 2] ELSE [0] END) AS again FROM ({_RUN_BASE})))"""


def run_table(spark, sf_dir):
    """A run's result table in the reference's wide layout (one projection
    over the turns: gold and scores are both row-wise). As in real runs ids
    repeat: every 13th dialogue's rows stand twice, equal in all; every 17th's
    have two rows more, whose NULLs stand elsewhere."""
    t = ad.turns(spark, sf_dir)
    quals = ("appropriateness", "richness", "grammatical", "relevance")
    score = {q: ad.score_tenths(i) / 10 for i, q in enumerate(quals)}
    again = F.when(F.col("dialogue_id") % 13 == 0, F.lit([0, 0])).when(F.col("dialogue_id") % 17 == 0, F.lit([0, 1, 2])).otherwise(F.lit([0]))
    t = t.select("*", F.explode(again).alias("_again"))
    gold = {q: ad.gold_expr(i) for i, q in enumerate(quals)}
    first, last = gold["appropriateness"], gold["relevance"]
    gold["appropriateness"] = F.when(F.col("_again") != 1, first)
    gold["relevance"] = F.when(F.col("_again") == 1, first).when(F.col("_again") == 0, last)
    return t.select(
        F.col("uid").alias("dialogue_id"),
        F.concat(F.lit("model-"), (F.col("dialogue_id") % 5).cast("string")).alias("model"),
        *[gold[q].alias(f"annotations.{q}") for q in quals],
        *[score[q].alias(f"LLM_{q}") for q in quals],
        ((score["appropriateness"] + score["relevance"]) / 2).alias("am_fm_scores"),
    )


_P12 = " UNION ALL ".join(
    [f"SELECT dialogue_id, 'annotations.{q}' AS column_name, 'gold' AS role, round(\"annotations.{q}\", 6) AS value "
     "FROM run" for q in ("appropriateness", "richness", "grammatical", "relevance")]
    + [f"SELECT dialogue_id, 'LLM_{q}', 'pred', round(LLM_{q}, 6) FROM run"
       for q in ("appropriateness", "richness", "grammatical", "relevance")]
)


@query("P12_discover_columns", sql(_P12, "scores_wide", "gold_wide", extra={"run": _RUN_COLS}))
def p12(spark, sf_dir):
    from turnscore.operators import mining as mn

    run = run_table(spark, sf_dir)
    gold_cols, pred_cols = mn.discover_columns(run.columns, metric="LLM")
    return mn.to_long(run, gold_cols, pred_cols)


@query(
    "P13_default_missing",
    sql("SELECT uid, quality, coalesce(gold, -1.0) AS gold FROM rl", "rl"),
)
def p13(spark, sf_dir):
    r = ad.scored_turns(spark, sf_dir)
    return r.select("uid", "quality", gd.or_default("gold", -1.0).alias("gold"))
