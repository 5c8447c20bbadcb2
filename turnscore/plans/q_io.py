"""Registered source / sink queries (S1-S9, round trips through the shared
checkpoint folder) and the E4 / E5 jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscore.operators import dialogues as dl
from turnscore.plans.oracle import rating_sql, sql
from turnscore.plans.registry import query
from turnscore.schemas import QUALITIES, TURN_DIMENSIONS, dialogue_schema
from turnscore.session import scratch_path
from turnscore.sources import adapters as ad
from turnscore.sources import io

# ------------------------------------------------------------------ S1 / S6


def _nested_dataset(spark, sf_dir):
    """Dialogue rows with a nested ``annotations`` struct: per quality the
    three annotator ratings."""
    d = ad.dialogue_rows(spark, sf_dir).withColumnRenamed("conv_id", "dialogue_key")
    ann = F.struct(*[F.array(*[ad.rating(k, i, dialogue="dialogue_key") for k in range(3)]).alias(q)
                     for i, q in enumerate(QUALITIES)])
    cols = [f.name for f in dialogue_schema(QUALITIES).fields if f.name != "annotations"]
    return d.select(*cols, ann.alias("annotations"))


_S1_SQL = " UNION ALL ".join(
    f"""SELECT dialogue_id, model, context, response, '{q}' AS annotation, CAST(3 AS INTEGER) AS n_ratings,
       round(({rating_sql(0, str(i), 'conv_id')} + {rating_sql(1, str(i), 'conv_id')} + {rating_sql(2, str(i), 'conv_id')})
             / 3, 6) AS mean_rating FROM drows"""
    for i, q in enumerate(QUALITIES)
)


@query("S1_read_dialogue_json", sql(_S1_SQL, "drows"))
def s1(spark, sf_dir):
    """Write the nested dataset as JSON lines, read it back with the explicit
    dataset schema and flatten the annotator lists."""
    path = scratch_path(spark, "s1-dataset")
    _nested_dataset(spark, sf_dir).write.mode("overwrite").json(path)
    back = io.read_dialogue_json(spark, path, dialogue_schema(QUALITIES), multiline=False)
    flat = io.flatten_annotations(back)
    mean = F.aggregate("ratings", F.lit(0.0), lambda a, x: a + x) / F.size("ratings")
    return flat.select("dialogue_id", "model", "context", "response", "annotation",
                       F.size("ratings").alias("n_ratings"), mean.alias("mean_rating"))


_REH_COLS = ("content", "grammar", "appropriateness", "relevance")


def _s6_sql():
    from turnscore.plans.q_text import _REH

    sel = """SELECT id AS dialogue_id, sid AS model, cont AS content, gram AS grammar, appr AS appropriateness,
       CASE WHEN is_first THEN 5.0 ELSE rel END AS relevance FROM rc"""
    body = " UNION ALL ".join(
        f"SELECT dialogue_id, model, '{c}' AS annotation, round({c}, 6) AS value, CAST(1 AS INTEGER) AS n_values "
        "FROM e5" for c in _REH_COLS
    )
    return sql(body, "rehearsal_in", extra={**_REH, "e5": sel})


@query("S6_write_nested_json", _s6_sql())
def s6(spark, sf_dir):
    """E5 output folded into nested one-element rating lists, written as
    JSON, read back through S1."""
    rows = dl.rehearsal_rows(ad.rehearsal_input(spark, sf_dir), "constant")
    path = scratch_path(spark, "s6-rehearsal")
    io.write_nested_json(rows, path, _REH_COLS)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("dialogue_id", "model", "context", "response")]
        + [T.StructField("annotations", T.StructType([T.StructField(c, T.ArrayType(T.DoubleType()))
                                                      for c in _REH_COLS]))]
    )
    back = io.flatten_annotations(io.read_dialogue_json(spark, path, schema, multiline=False))
    return back.select("dialogue_id", "model", "annotation", F.get("ratings", 0).alias("value"),
                       F.size("ratings").alias("n_values"))


# ------------------------------------------------------------------ S2 / S5


_S2_SQL = f"""SELECT g."UID", g."SID", t.text AS "PARAPHRASES", {', '.join(f'round(g."{d}", 6) AS "{d}"' for d in TURN_DIMENSIONS)}
FROM gold_wide g JOIN turns t ON t.uid = g."UID\""""


@query("S2_read_turn_csv", sql(_S2_SQL, "gold_wide", "turns"))
def s2(spark, sf_dir):
    """Gold turns with their multi-line text written as CSV, read back with
    an explicit schema."""
    t = ad.turns(spark, sf_dir)
    g = t.select(F.col("uid").alias("UID"), F.col("sid").alias("SID"), F.col("text").alias("PARAPHRASES"),
                 *[ad.gold_expr(i).alias(d) for i, d in enumerate(TURN_DIMENSIONS)])
    path = scratch_path(spark, "s2-gold")
    io.write_csv(g, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("UID", "SID", "PARAPHRASES")]
                          + [T.StructField(d, T.DoubleType()) for d in TURN_DIMENSIONS])
    return io.read_csv(spark, path, schema)


@query(
    "S5_write_csv",
    sql("SELECT dialogue_id, model, context, response FROM drows", "drows"),
)
def s5(spark, sf_dir):
    """Dialogue rows (newlines, empty responses) through the CSV sink."""
    d = ad.dialogue_rows(spark, sf_dir).select("dialogue_id", "model", "context", "response")
    path = scratch_path(spark, "s5-csv")
    io.write_csv(d, path)
    return io.read_csv(spark, path, d.schema)


# ------------------------------------------------------------------ S3 / S9 / S7 / S8


@query(
    "S3_read_run_results",
    sql("""SELECT uid, appropriateness, richness, grammatical, relevance, '007' AS run_id FROM scores_wide""",
        "scores_wide"),
)
def s3(spark, sf_dir):
    """Two runs with like ids in one result table; reading one is partition
    pruning on the id as it was given."""
    s = ad.scores_wide(spark, sf_dir).select("uid", *QUALITIES)
    root = scratch_path(spark, "s3-results")
    io.write_results(s, root, "007")
    io.write_results(s.select("uid", *[(F.col(q) + 1).alias(q) for q in QUALITIES]), root, "7")
    return io.read_results(spark, root, "007")


@query(
    "S9_result_table_sink",
    sql("""SELECT 'run-a' AS run_id, count(*) AS n_rows FROM rl
UNION ALL SELECT 'run-b', count(*) FROM rl WHERE sid = 'Chatbot'""", "rl"),
)
def s9(spark, sf_dir):
    """Append two scored frames as runs of the results table; count per run."""
    r = ad.scored_turns(spark, sf_dir).select("uid", "quality", "score", "sid")
    root = scratch_path(spark, "s9-results")
    io.write_results(r, root, "run-a")
    io.write_results(r.where(F.col("sid") == "Chatbot"), root, "run-b")
    io.write_results(r, root, "run-a")  # a re-run takes the place of the first
    return io.read_all_runs(spark, root).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "S7_embedding_store",
    sql("""SELECT dialogue_id, CASE WHEN vec_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split,
       CAST(len(embedding) AS INTEGER) AS n_dims,
       round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 6) AS emb_sum
FROM emb_records""", "emb_records"),
)
def s7(spark, sf_dir):
    """Embedding records saved by run and split, both splits read back; the
    check weighs every component by its place."""
    r = ad.embedding_records(spark, sf_dir)
    root = scratch_path(spark, "s7-embeddings")
    io.write_embeddings(r.where(F.col("vec_id") % 5 != 0), root, "run-a", "train")
    io.write_embeddings(r.where(F.col("vec_id") % 5 == 0), root, "run-a", "dev")
    back = io.read_embeddings(spark, root, "run-a", "dev").unionByName(io.read_embeddings(spark, root, "run-a", "train"))
    weighed = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return back.select("dialogue_id", "split", F.size("embedding").alias("n_dims"),
                       F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x).alias("emb_sum"))


@query(
    "S8_run_manifest",
    sql("""SELECT uid, quality, score, 'run-a' AS run_id, 'op-all-02' AS prompt FROM rl""",
        "rl"),
)
def s8(spark, sf_dir):
    """Persist run records; scores inherit their run's prompt by a join."""
    root = scratch_path(spark, "s8-runs")
    io.append_run(spark, root, "run-a", "op-all-02", "heuristic", 42, eval_type="en", insert_speaker=False)
    io.append_run(spark, root, "run-b", "vh-appropriateness-03", "heuristic", 7, eval_type="par")
    runs = io.read_runs(spark, root)
    s = ad.scored_turns(spark, sf_dir).select(
        "uid", "quality", "score", F.lit("run-a").alias("run_id"))
    # the runs table grows with the number of runs: no forced broadcast, AQE
    # broadcasts it at run time when it is small
    return s.join(runs.select("run_id", "prompt"), "run_id").select(
        "uid", "quality", "score", "run_id", "prompt")


# ------------------------------------------------------------------ E4 / E5


def _e4_sql():
    from turnscore.plans.q_windows import _HARD, _MINING

    return sql("""SELECT d.dialogue_id, d.dataset, d.model, round(s.share, 6) AS source_share FROM drows d
JOIN (SELECT DISTINCT dialogue_id, model FROM run WHERE dialogue_id IN (SELECT dialogue_id FROM (""" + _HARD + """))) r
  ON r.dialogue_id = d.dialogue_id
JOIN (SELECT h.model, count(*) / sum(count(*)) OVER () AS share FROM (""" + _HARD + """) h GROUP BY h.model) s ON s.model = r.model""",
               "drows", "scores_wide", "gold_wide", extra=_MINING)


@query("E4_mine_hard_set", _e4_sql())
def e4(spark, sf_dir):
    """Whole job: a run's results stored and read back (S9, S3), rank
    disagreement, hardest 200, source shares, hard subset of the dataset, and
    the share of each row's response source."""
    from turnscore.plans.jobs import mine_hard_set
    from turnscore.plans.q_rows import run_table

    root = scratch_path(spark, "e4-results")
    io.write_results(run_table(spark, sf_dir), root, "run-a")
    run = io.read_results(spark, root, "run-a").drop("run_id")
    d = ad.dialogue_rows(spark, sf_dir).select("dialogue_id", "dataset", "model", "context", "response")
    _, shares, subset = mine_hard_set(run, d, "LLM", 200)
    source = run.select("dialogue_id", F.col("model").alias("source")).distinct()
    return subset.join(source, "dialogue_id").join(shares.select(F.col("model").alias("source"), "share"), "source").select(
        "dialogue_id", "dataset", "model", F.col("share").alias("source_share"))


@query(
    "E5_build_rehearsal",
    sql("""SELECT id AS dialogue_id, sid AS model, CASE WHEN is_first THEN '' ELSE context END AS context, response,
       cont AS content, gram AS grammar, appr AS appropriateness, CASE WHEN is_first THEN 5.0 ELSE rel END AS relevance
FROM rc""", "rehearsal_in", extra=__import__("turnscore.plans.q_text", fromlist=["_REH"])._REH),
)
def e5(spark, sf_dir):
    """Whole job: rehearsal input from a CSV file (S2), rehearsal rows (constant
    variant), written as a dataset file (S6) and read back by its layout (S1)."""
    from turnscore.plans.jobs import build_rehearsal

    source = ad.rehearsal_input(spark, sf_dir)
    path = scratch_path(spark, "e5-rehearsal")
    io.write_csv(source, f"{path}/csv")
    rows = build_rehearsal(io.read_csv(spark, f"{path}/csv", source.schema), "constant")
    io.write_nested_json(rows, f"{path}/json", _REH_COLS)
    back = io.read_dialogue_json(spark, f"{path}/json", dialogue_schema(_REH_COLS))
    return back.select("dialogue_id", "model", "context", "response", *[F.get(F.col("annotations")[c], 0).alias(c) for c in _REH_COLS])
