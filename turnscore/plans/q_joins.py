"""Registered join, set and submission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.operators import dialogues as dl
from turnscore.operators import features as fe
from turnscore.operators import submissions as sb
from turnscore.operators.identity import PLACE
from turnscore.plans.oracle import gold_sql, sql, tenths_sql, trim_ws_sql
from turnscore.plans.registry import query
from turnscore.schemas import TURN_DIMENSIONS
from turnscore.sources import adapters as ad

_DIMS = ", ".join(f'"{d}"' for d in TURN_DIMENSIONS)

# ------------------------------------------------------------------ J1


def _at(file: str, row):
    """The place of a row in a file."""
    return F.struct(F.lit(file).alias("file"), F.lit(0).cast("long").alias("block"), row.alias("row")).alias(PLACE)


def _gold_file(spark, sf_dir):
    """Gold rows with a file position; some turns lack gold, some have a
    later duplicate with other values (the first must win)."""
    t = ad.turns(spark, sf_dir)
    pos = (F.col("dialogue_id") * 100 + F.col("turn_id")) * 2
    base = t.where((F.col("dialogue_id") + F.col("turn_id")) % 23 != 0).select(
        F.col("uid").alias("UID_TEST"), _at("gold.csv", pos),
        *[ad.gold_expr(i).alias(d) for i, d in enumerate(TURN_DIMENSIONS)],
    )
    dup = t.where(((F.col("dialogue_id") + F.col("turn_id")) % 23 != 0)
                  & ((F.col("dialogue_id") + F.col("turn_id")) % 9 == 0)).select(
        F.col("uid").alias("UID_TEST"), _at("gold.csv", pos + 1),
        *[(ad.gold_expr(i) + 0.5).alias(d) for i, d in enumerate(TURN_DIMENSIONS)],
    )
    return base.unionByName(dup)


_G0 = " UNION ALL ".join([
    f"""SELECT uid AS k, (dialogue_id * 100 + turn_id) * 2 AS _row, {gold_sql('0')} AS "APPROPRIATENESS",
       {gold_sql('1')} AS "CONTENT_RICHNESS", {gold_sql('2')} AS "GRAMMATICAL_CORRECTNESS", {gold_sql('3')} AS "RELEVANCE"
FROM turns WHERE (dialogue_id + turn_id) % 23 <> 0""",
    f"""SELECT uid, (dialogue_id * 100 + turn_id) * 2 + 1, {gold_sql('0')} + 0.5, {gold_sql('1')} + 0.5,
       {gold_sql('2')} + 0.5, {gold_sql('3')} + 0.5
FROM turns WHERE (dialogue_id + turn_id) % 23 <> 0 AND (dialogue_id + turn_id) % 9 = 0""",
])


@query(
    "J1_gold_lookup",
    sql(f"""SELECT t.uid, {', '.join(f'round(g."{d}", 6) AS "{d}"' for d in TURN_DIMENSIONS)},
       g.k IS NOT NULL AS matched
FROM turns t LEFT JOIN (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY _row) = 1) g
  ON g.k = t.uid""", "turns", extra={"g0": _G0}),
)
def j1(spark, sf_dir):
    t = ad.turns(spark, sf_dir).select("uid")
    out = sb.gold_lookup(t, _gold_file(spark, sf_dir), uid="uid", gold_key="UID_TEST")
    return out.select("uid", *TURN_DIMENSIONS, "matched")


# ------------------------------------------------------------------ J2


def _long_sql(src: str, value: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT "UID", '{d}' AS dimension, "{d}" AS {value} FROM {src} {where}""" for d in TURN_DIMENSIONS
    )


@query(
    "J2_submission_gold_align",
    sql("""SELECT g."UID", g.dimension, g.gold, p.pred, p."UID" IS NOT NULL AS matched, coalesce(p.n_duplicates, 0) AS n_duplicates FROM gl g
LEFT JOIN pl p ON p."UID" = g."UID" AND p.dimension = g.dimension""", "gold_wide", "subfirst",
        extra={"gl": _long_sql("gold_wide", "gold", """WHERE "SID" = 'Chatbot'"""),
               "pl": " UNION ALL ".join(f"""SELECT "UID", '{d}' AS dimension, "{d}" AS pred, n_duplicates FROM subfirst""" for d in TURN_DIMENSIONS)}),
)
def j2(spark, sf_dir):
    from turnscore.operators import agreement as ag

    g = ag.eval_slice(ad.turn_gold_wide(spark, sf_dir), "t2t").unpivot(["UID"], list(TURN_DIMENSIONS),
                                                                      "dimension", "gold")
    p = ad.submission_rows(spark, sf_dir).unpivot(["UID", "_place"], list(TURN_DIMENSIONS), "dimension", "pred")
    return sb.align(g, p)


# ------------------------------------------------------------------ J3 / A11 / U2 / E2


def quality_files(spark, sf_dir, complete=False):
    """Four per-quality score files; unless ``complete``, the richness file
    misses some UIDs, all repeat some turns further down with other scores, and
    the relevance file repeats some once more."""
    s = ad.scores_wide(spark, sf_dir)
    quals = ("appropriateness", "richness", "grammatical", "relevance")
    files = {}
    for q, d in zip(quals, TURN_DIMENSIONS):
        f = s
        if q == "richness" and not complete:
            f = s.where((F.col("dialogue_id") + F.col("turn_id")) % 13 != 0)
        if not complete:
            key = F.col("dialogue_id") + F.col("turn_id")
            last = [F.lit(2)] if q == "relevance" else []
            f = f.select("*", F.explode(F.when(key % 11 == 0, F.array(F.lit(0), F.lit(1), *last)).otherwise(F.array(F.lit(0)))).alias("_again"))
            row = F.col("_again") * 10_000_000 + F.col("dialogue_id") * 100 + F.col("turn_id")
            files[d] = f.select(F.col("uid").alias("UID"), (F.col(q) + F.col("_again")).alias(q), _at(f"{q}.csv", row))
        else:
            files[d] = f.select(F.col("uid").alias("UID"), F.col(q))
    return files


def _file_sql(q: int, extra_where: str = "", times: int = 2) -> str:
    return f"""SELECT "UID", v + again AS v, row_number() OVER (PARTITION BY "UID" ORDER BY again) AS nth
FROM (SELECT uid AS "UID", {tenths_sql(str(q))} / 10 AS v,
             unnest(CASE WHEN (dialogue_id + turn_id) % 11 = 0 THEN {list(range(times))} ELSE [0] END) AS again FROM turns {extra_where})"""


_FILES = {
    "fa": _file_sql(0),
    "fr": _file_sql(1, "WHERE (dialogue_id + turn_id) % 13 <> 0"),
    "fg": _file_sql(2),
    "fl": _file_sql(3, times=3),
}
_MERGED = """SELECT "UID", fa.v AS "APPROPRIATENESS", fr.v AS "CONTENT_RICHNESS", fg.v AS "GRAMMATICAL_CORRECTNESS", fl.v AS "RELEVANCE",
       (fa.v IS NOT NULL AND fr.v IS NOT NULL AND fg.v IS NOT NULL AND fl.v IS NOT NULL) AS complete
FROM fa FULL OUTER JOIN fr USING ("UID", nth) FULL OUTER JOIN fg USING ("UID", nth) FULL OUTER JOIN fl USING ("UID", nth)"""


@query("J3_submission_merge", sql("SELECT * FROM merged", "turns", extra={**_FILES, "merged": _MERGED}))
def j3(spark, sf_dir):
    return sb.merge_quality_files(quality_files(spark, sf_dir))


@query(
    "A11_submission_checks",
    sql("""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_duplicate_uids,
       count(*) FILTER (WHERE NOT all_complete) AS n_incomplete, CAST(1790 AS BIGINT) AS expected_rows,
       (sum(n) = 1790 AND count(*) FILTER (WHERE n > 1) = 0 AND count(*) FILTER (WHERE NOT all_complete) = 0) AS ok
FROM (SELECT "UID", count(*) AS n, bool_or(complete) AS all_complete FROM thrice GROUP BY "UID")""",
        "turns", extra={**_FILES, "merged": _MERGED,
                        "thrice": """SELECT * FROM merged UNION ALL SELECT * FROM merged WHERE ends_with("UID", '3')
UNION ALL SELECT * FROM merged WHERE ends_with("UID", '3')"""}),
)
def a11(spark, sf_dir):
    """Checks over merged files in which the third turns occur three times."""
    merged = sb.merge_quality_files(quality_files(spark, sf_dir))
    again = merged.where(F.col("UID").endswith("3"))
    return sb.submission_checks(merged.unionByName(again).unionByName(again), 1790)


@query(
    "U2_uid_set_difference",
    sql("""SELECT 'left_only' AS side, "UID" FROM (SELECT "UID" FROM fa EXCEPT ALL SELECT "UID" FROM fr)
UNION ALL SELECT 'right_only', "UID" FROM (SELECT "UID" FROM fr EXCEPT ALL SELECT "UID" FROM fa)""",
        "turns", extra={"fa": _FILES["fa"], "fr": _FILES["fr"]}),
)
def u2(spark, sf_dir):
    f = quality_files(spark, sf_dir)
    return sb.uid_difference(f["APPROPRIATENESS"], f["CONTENT_RICHNESS"])


@query(
    "E2_build_submission",
    sql("""SELECT "UID", round("APPROPRIATENESS", 6) AS "APPROPRIATENESS", round("CONTENT_RICHNESS", 6) AS "CONTENT_RICHNESS",
       round("GRAMMATICAL_CORRECTNESS", 6) AS "GRAMMATICAL_CORRECTNESS", round("RELEVANCE", 6) AS "RELEVANCE"
FROM merged WHERE NOT coalesce(ends_with("UID", '0000'), false)""", "turns",
        extra={**{k: _file_sql(i, times=1) for i, k in enumerate(_FILES)}, "merged": _MERGED}),
)
def e2(spark, sf_dir):
    """Whole job: merge four complete files, check them (on), drop first turns
    (``0000``) and compare with the expected number of rows; written and read
    back as the submission file (S5)."""
    from turnscore.plans.jobs import build_submission
    from turnscore.session import scratch_path
    from turnscore.sources import io

    expected = dl.drop_first_turns(ad.turns(spark, sf_dir), "uid", "0000").count()
    out = build_submission(quality_files(spark, sf_dir, complete=True), expected_rows=expected)
    path = scratch_path(spark, "e2-submission")
    io.write_csv(out, path)
    return io.read_csv(spark, path, out.schema)


# ------------------------------------------------------------------ T3 / J4 / U1


@query(
    "T3_cap_examples",
    sql(f"""SELECT uid, context FROM (SELECT uid, coalesce(string_agg({trim_ws_sql('text')}, chr(10)) OVER (
        PARTITION BY dialogue_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
FROM turns WHERE NOT coalesce(ends_with(uid, '000'), false)) ORDER BY uid LIMIT 100""", "turns"),
)
def t3(spark, sf_dir):
    t = dl.dialogue_context(dl.drop_first_turns(ad.turns(spark, sf_dir))).select("uid", "context")
    return sb.cap_rows(t, 100)


@query(
    "J4_banned_context_anti",
    sql("""SELECT dialogue_id, conv_id FROM drows d
WHERE NOT EXISTS (SELECT 1 FROM drows b WHERE b.conv_id % 5 = 0 AND b.context = d.context)""", "drows"),
)
def j4(spark, sf_dir):
    d = ad.dialogue_rows(spark, sf_dir)
    dev = d.where(F.col("conv_id") % 5 == 0)
    return sb.drop_banned_contexts(d, dev).select("dialogue_id", "conv_id")


@query(
    "U1_union_datasets",
    sql("""SELECT 'train-a' AS dataset, dialogue_id, NULL::VARCHAR AS model, response FROM drows WHERE conv_id % 3 = 0
UNION ALL SELECT 'train-b', dialogue_id, model, response FROM drows WHERE conv_id % 3 = 1
UNION ALL SELECT 'train-c', dialogue_id, model, NULL::VARCHAR FROM drows WHERE conv_id % 3 = 2""", "drows"),
)
def u1(spark, sf_dir):
    d = ad.dialogue_rows(spark, sf_dir)
    parts = {
        "train-a": d.where(F.col("conv_id") % 3 == 0).select("dialogue_id", "response"),
        "train-b": d.where(F.col("conv_id") % 3 == 1).select("dialogue_id", "model", "response"),
        "train-c": d.where(F.col("conv_id") % 3 == 2).select("dialogue_id", "model"),
    }
    return sb.union_datasets(parts).select("dataset", "dialogue_id", "model", "response")


# ------------------------------------------------------------------ A14 / J6

_POOL = """SELECT vec_id, j, max(v) AS mx, avg(v) AS av FROM (
  SELECT vec_id, r2.j, CAST(embedding[r1.t * 8 + r2.j + 1] AS DOUBLE) AS v
  FROM embeddings, range(8) r1(t), range(8) r2(j)) GROUP BY vec_id, j"""


@query(
    "A14_token_pooling",
    sql("""SELECT vec_id, CAST(16 AS BIGINT) AS n_pooled, round(sum(mx) + sum(av), 6) AS pooled_sum,
       round(max(mx) FILTER (WHERE j = 0), 6) AS pooled_first, round(max(av) FILTER (WHERE j = 7), 6) AS pooled_last
FROM pool GROUP BY vec_id""", extra={"pool": _POOL}),
)
def a14(spark, sf_dir):
    e = ad.sf_table(spark, sf_dir, "embeddings")
    pooled = fe.max_and_avg_pool(fe.tokens_from_flat("embedding", 8, 8))
    return e.select("vec_id", *fe.vector_summary(pooled, "pooled"))


def _members(spark, sf_dir):
    r = ad.embedding_records(spark, sf_dir)
    m0 = r.select("dialogue_id", F.lit(0).alias("member"), "embedding", "score")
    m1 = r.where(F.col("vec_id") % 50 != 7).select(
        "dialogue_id", F.lit(1).alias("member"), F.reverse("embedding").alias("embedding"),
        (F.lit(1) + (F.col("vec_id") * 3 % 41) / 10).alias("score"),
    )
    return m0.unionByName(m1)


_J6 = """SELECT e.dialogue_id,
       list_concat(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), [e.score],
         CASE WHEN e.vec_id % 50 <> 7 THEN list_concat(list_transform(list_reverse(e.embedding),
              lambda x: CAST(x AS DOUBLE)), [1 + (e.vec_id * 3 % 41) / 10]) ELSE []::DOUBLE[] END) AS f,
       e.vec_id % 50 <> 7 AS complete
FROM emb_records e"""


@query(
    "J6_ensemble_features",
    sql("""SELECT dialogue_id, CAST(len(f) AS BIGINT) AS n_feat, round(list_sum(f), 6) AS feat_sum,
       round(f[1], 6) AS feat_first, round(f[len(f)], 6) AS feat_last, complete FROM j6""",
        "emb_records", extra={"j6": _J6}),
)
def j6(spark, sf_dir):
    ens = fe.ensemble_features(_members(spark, sf_dir), 2, score="score")
    return ens.select("dialogue_id", *fe.vector_summary("features", "feat"), "complete")
