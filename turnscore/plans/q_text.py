"""Registered text queries: prompts, replies, rehearsal rows, ids
(SURVEY 2.8, A8, A15, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.functions import ids, prompts, replies
from turnscore.operators import dialogues as dl
from turnscore.plans.oracle import (
    first_token_sql,
    parse_multi_sql,
    py_float_sql,
    render_sql,
    sql,
    trim_ws_sql,
)
from turnscore.plans.registry import query
from turnscore.schemas import QUALITIES
from turnscore.sources import adapters as ad

_HIST = f"""SELECT uid, sid, text, coalesce(string_agg({trim_ws_sql('text')}, chr(10)) OVER (PARTITION BY dialogue_id
        ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
FROM turns WHERE NOT coalesce(ends_with(uid, '000'), false)"""
_RESP_SQL = trim_ws_sql("CASE WHEN text = '' THEN 'no response' ELSE text END")


def kept_pairs(spark, sf_dir):
    """All kept turns with their history (W1) and cleaned response."""
    t = dl.dialogue_context(dl.drop_first_turns(ad.turns(spark, sf_dir)))
    return dl.prepare_pairs(t.select("uid", "context", F.col("text").alias("response")))


_F1 = prompts.get_prompt("vh-appropriateness-03")


@query(
    "F1_render_prompt",
    sql(f"""SELECT uid, {render_sql(_F1.template, {'dialogue_context': 'context', 'response': _RESP_SQL})} AS prompt
FROM h""", "turns", extra={"h": _HIST}),
)
def f1(spark, sf_dir):
    p = kept_pairs(spark, sf_dir)
    return p.select("uid", prompts.render_prompt(_F1).alias("prompt"))


_ALL = list(prompts.PROMPTS)


def _m4_sql():
    parts = []
    for n in _ALL:
        p = prompts.get_prompt(n)
        txt = render_sql(p.template, {"dialogue_context": "context", "response": _RESP_SQL})
        parts.append(f"SELECT uid, '{n}' AS prompt, {len(p.qualities)} AS n_qualities, md5({txt}) AS prompt_md5, "
                     f"CAST(length({txt}) AS BIGINT) AS prompt_chars FROM h")
    return " UNION ALL ".join(parts)


@query("M4_prompt_table", sql(_m4_sql(), "turns", extra={"h": _HIST}))
def m4(spark, sf_dir):
    """Every turn rendered with every registered prompt in one job: a turn
    fans out over the prompt names and meets the fixed prompt table (27 rows),
    whose pieces are filled row by row."""
    p = kept_pairs(spark, sf_dir)
    x = p.withColumn("prompt", F.explode(F.array(*[F.lit(n) for n in _ALL]))).join(F.broadcast(prompts.prompt_table(spark)), "prompt")
    text = prompts.render_parts(F.col("parts"), F.col("context"), F.col("response"))
    return x.select("uid", "prompt", F.size("qualities").alias("n_qualities"), F.md5(text).alias("prompt_md5"),
                    F.length(text).cast("long").alias("prompt_chars"))


@query(
    "F3_parse_single",
    sql(f"SELECT uid, {py_float_sql(first_token_sql('reply'))} AS value FROM replies", "replies"),
)
def f3(spark, sf_dir):
    r = ad.replies(spark, sf_dir)
    return r.select("uid", replies.parse_single("reply").alias("value"))


_F4 = " UNION ALL ".join(
    f"SELECT uid, '{q}' AS quality, {parse_multi_sql('reply', q)} AS value FROM replies" for q in QUALITIES
)


@query("F4_parse_multi", sql(_F4, "replies"))
def f4(spark, sf_dir):
    r = ad.replies(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(q).alias("quality"), replies.parse_multi("reply", q).alias("value"))
                    for q in QUALITIES])
    return r.select("uid", F.inline(arr))


_F5 = """SELECT uid, quality, coalesce(value, 3.0) AS score, CAST(value IS NULL AS INTEGER) AS parse_error,
       CAST(value IS NOT NULL AND (value < 1 OR value > 5) AS INTEGER) AS out_of_range FROM f4"""


@query("F5_default_and_flag", sql(_F5, "replies", extra={"f4": _F4}))
def f5(spark, sf_dir):
    r = ad.replies(spark, sf_dir)
    return replies.parse_replies(r, QUALITIES, "reply")


_F3_SINGLE = f"""SELECT uid, 'appropriateness' AS quality,
       coalesce({py_float_sql(first_token_sql('reply'))}, {parse_multi_sql('reply', 'appropriateness')}) AS value
FROM replies"""


@query(
    "A8_parse_error_totals",
    sql("""SELECT 'op-all-02' AS prompt, quality, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
       count(*) AS n_turns FROM f4 GROUP BY quality
UNION ALL
SELECT 'vh-appropriateness-03', quality, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT),
       count(*) FROM f3s GROUP BY quality""", "replies", extra={"f4": _F4, "f3s": _F3_SINGLE}),
)
def a8(spark, sf_dir):
    r = ad.replies(spark, sf_dir)
    multi = replies.parse_error_totals(replies.parse_replies(r, QUALITIES, "reply"))
    single = replies.parse_error_totals(replies.parse_replies(r, ("appropriateness",), "reply"))
    return multi.select(F.lit("op-all-02").alias("prompt"), "*").unionByName(
        single.select(F.lit("vh-appropriateness-03").alias("prompt"), "*")
    )


# ------------------------------------------------------------------ rehearsal

def _tv(k):
    return f"CASE WHEN o_cont IS NOT NULL THEN (p_{k} + o_{k}) / 2 ELSE p_{k} END"


_REH_BASE = f"""SELECT id, sid, response, string_split(id, '-')[2] AS dk,
       CAST(string_split(id, '-')[-1] AS BIGINT) AS tn, ends_with(string_split(id, '-')[-1], '0') AS is_first,
       {_tv('appr')} AS appr, {_tv('cont')} AS cont, {_tv('gram')} AS gram, {_tv('rel')} AS rel,
       (p_appr + o_appr) / 2 AS copy_rel
FROM rehearsal_in"""
_REH_SEG = """SELECT *, sum(CASE WHEN is_first THEN 1 ELSE 0 END) OVER (PARTITION BY dk ORDER BY tn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM rb"""
_REH_CTX = """SELECT *, coalesce(string_agg(response, chr(10)) OVER (PARTITION BY dk, segment ORDER BY tn
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM rs"""
_REH = {"rb": _REH_BASE, "rs": _REH_SEG, "rc": _REH_CTX}


@query(
    "A15_two_view_rating",
    sql("SELECT id, appr AS appropriateness, cont AS content, gram AS grammar, rel AS relevance FROM rb",
        "rehearsal_in", extra={"rb": _REH_BASE}),
)
def a15(spark, sf_dir):
    r = ad.rehearsal_input(spark, sf_dir)
    has_o = F.col("o_cont").isNotNull()
    return r.select(
        "id",
        *[dl.two_view(F.col(f"p_{k}"), F.col(f"o_{k}"), has_o).alias(n)
          for k, n in (("appr", "appropriateness"), ("cont", "content"), ("gram", "grammar"), ("rel", "relevance"))],
    )


@query(
    "F6_rehearsal_variant",
    sql(
        """SELECT v.variant, id AS dialogue_id, sid AS model, CASE WHEN is_first THEN '' ELSE context END AS context,
       response, cont AS content, gram AS grammar, appr AS appropriateness,
       CASE WHEN is_first AND v.variant = 'constant' THEN 5.0
            WHEN is_first AND v.variant = 'copy' THEN copy_rel ELSE rel END AS relevance
FROM rc CROSS JOIN (VALUES ('constant'), ('copy'), ('omit')) AS v(variant)
WHERE NOT (v.variant = 'omit' AND is_first)""",
        "rehearsal_in", extra=_REH,
    ),
)
def f6(spark, sf_dir):
    return dl.rehearsal_variants(ad.rehearsal_input(spark, sf_dir))


@query("F7_stable_id", sql("SELECT uid, md5(concat_ws('|', '42', uid)) AS stable_id FROM turns", "turns"))
def f7(spark, sf_dir):
    t = ad.turns(spark, sf_dir)
    return t.select("uid", ids.stable_id(42, "uid").alias("stable_id"))
