"""Registered model-surface queries: M1-M3, M5-M7, T5, E1, E6."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.functions import prompts, replies
from turnscore.operators import features as fe
from turnscore.operators import gold as gd
from turnscore.operators import regression as rg
from turnscore.operators import scoring as sc
from turnscore.plans.oracle import avg_rank_sql, corr_sql, render_sql, sql
from turnscore.plans.q_text import _HIST, _RESP_SQL, kept_pairs
from turnscore.plans.registry import query
from turnscore.schemas import QUALITIES
from turnscore.sources import adapters as ad

PROMPT = prompts.get_prompt("op-all-02")

_PROMPT_SQL = render_sql(PROMPT.template, {"dialogue_context": "context", "response": _RESP_SQL})
_EXCL = "(length(r) - length(replace(r, '!', '')) + length(r) - length(replace(r, '?', '')))"
_HEUR = f"""SELECT uid, CAST(1 + (length(r) + length(c)) % 5 AS DOUBLE) AS appropriateness,
       CAST(1 + least(4, length(r) // 200) AS DOUBLE) AS richness,
       CAST(greatest(1, 5 - least(4, {_EXCL})) AS DOUBLE) AS grammatical,
       CAST(1 + (length(p) // 100) % 5 AS DOUBLE) AS relevance, md5(uid) LIKE '0%' AS failed
FROM (SELECT uid, context AS c, {_RESP_SQL} AS r, {_PROMPT_SQL} AS p FROM h)"""


def _heur_long(fail: bool) -> str:
    parts = []
    for q in QUALITIES:
        if fail:
            parts.append(f"""SELECT uid, '{q}' AS quality, CASE WHEN failed THEN 3.0 ELSE {q} END AS score,
       CAST(failed AS INTEGER) AS parse_error, CAST(failed AS INTEGER) AS call_failed FROM heur""")
        else:
            parts.append(f"SELECT uid, '{q}' AS quality, {q} AS score, 0 AS parse_error, 0 AS call_failed FROM heur")
    return " UNION ALL ".join(parts)


def scored(spark, sf_dir, fail_prefix=None):
    pairs = kept_pairs(spark, sf_dir).withColumn("prompt", prompts.render_prompt(PROMPT))
    raw = sc.batch_score(pairs, sc.heuristic_scorer(fail_prefix), keep=("uid",))
    parsed = replies.parse_replies(raw, PROMPT.qualities, "reply", keep=("uid", "call_failed"))
    return parsed.select("uid", "quality", "score", "parse_error", "call_failed")


@query("M1_batch_score", sql(_heur_long(False), "turns", extra={"h": _HIST, "heur": _HEUR}))
def m1(spark, sf_dir):
    """Render, call the (heuristic) scorer per partition, parse."""
    return scored(spark, sf_dir)


@query("M2_score_fallback", sql(_heur_long(True), "turns", extra={"h": _HIST, "heur": _HEUR}))
def m2(spark, sf_dir):
    """Injected service failures (md5(uid) starting with 0) become the
    fallback reply 3.0 with ``call_failed = 1``."""
    return scored(spark, sf_dir, fail_prefix="0")


_M3 = {
    "p": f"SELECT uid, {_RESP_SQL} AS r FROM h",
    "tk": "SELECT uid, list_filter(string_split_regex(lower(r), '[ \\t\\n\\r\\x0b\\x0c]+'), "
          "lambda x: x <> '') AS toks FROM p",
    "t1": "SELECT uid, len(toks) AS n_tok, unnest(toks) AS tok, unnest(range(len(toks))) AS ti FROM tk",
    "gr": "SELECT uid, n_tok, ti, unnest(list_concat([tok], list_transform(range(greatest(0, length(tok) - 2)), "
          "lambda i: substring(tok, i + 1, 3)))) AS g FROM t1",
    "hh": "SELECT uid, n_tok, ti, CAST(('0x' || substr(md5(g), 1, 8)) AS BIGINT) AS h FROM gr",
    "cell": "SELECT uid, n_tok, ti, h % 16 AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1.0 ELSE -1.0 END) AS v "
            "FROM hh GROUP BY uid, n_tok, ti, h % 16",
    "nrm": "SELECT uid, ti, sqrt(sum(v * v)) AS nv FROM cell GROUP BY uid, ti",
    "val": "SELECT c.uid, c.n_tok, c.ti, c.d, CAST(CAST(c.v / CASE WHEN n.nv = 0 THEN 1.0 ELSE n.nv END AS FLOAT) "
           "AS DOUBLE) AS x FROM cell c JOIN nrm n ON n.uid = c.uid AND n.ti = c.ti",
    "dims": "SELECT uid, d, CAST(CAST(CASE WHEN count(DISTINCT ti) < max(n_tok) THEN greatest(max(x), 0.0) "
            "ELSE max(x) END AS FLOAT) AS DOUBLE) AS mx, CAST(CAST(sum(x) / max(n_tok) AS FLOAT) AS DOUBLE) AS av "
            "FROM val GROUP BY uid, d",
}


@query(
    "M3_embed_turns",
    sql("""SELECT tk.uid, CAST(len(tk.toks) AS INTEGER) AS n_tokens, CAST(32 AS BIGINT) AS n_emb,
       round(coalesce(sum(dims.mx + dims.av), 0.0), 6) AS emb_sum,
       round(coalesce(max(dims.mx) FILTER (WHERE dims.d = 0), 0.0), 6) AS emb_first,
       round(coalesce(max(dims.av) FILTER (WHERE dims.d = 15), 0.0), 6) AS emb_last
FROM tk LEFT JOIN dims ON dims.uid = tk.uid GROUP BY tk.uid, tk.toks""", "turns", extra={"h": _HIST, **_M3}),
)
def m3(spark, sf_dir):
    """Token vectors per kept turn, pooled (A14) into one embedding."""
    pairs = kept_pairs(spark, sf_dir)
    emb = sc.pooled_embeddings(pairs, "response", "uid")
    return emb.select("uid", "n_tokens", *fe.vector_summary("embedding", "emb"))


_E1_ROWS = """SELECT g.quality, g.gold, s.score FROM rl g LEFT JOIN sl s ON g.uid = s.uid AND g.quality = s.quality
WHERE g.gold IS NOT NULL AND NOT isnan(g.gold)"""
_E1_RANK = f"""SELECT quality, gold, score, {avg_rank_sql('gold', 'quality')} AS gr, {avg_rank_sql('score', 'quality')} AS pr
FROM e1r WHERE score IS NOT NULL"""


@query(
    "E1_score_and_evaluate",
    sql(f"""SELECT quality, count(*) AS n, (SELECT count(*) FROM e1r m WHERE m.quality = e1.quality AND m.score IS NULL) AS n_missing,
       round({corr_sql('gold', 'score')}, 6) AS pearson, round({corr_sql('gr', 'pr')}, 6) AS spearman FROM e1 GROUP BY quality""",
        "rl", extra={"h": _HIST, "heur": _HEUR, "sl": _heur_long(False), "e1r": _E1_ROWS, "e1": _E1_RANK}),
)
def e1(spark, sf_dir):
    """Whole job: history, prompt, scorer, parse, agreement with gold."""
    from turnscore.plans.jobs import score_and_evaluate

    gold = ad.gold_long(spark, sf_dir).select("uid", "quality", "gold")
    _, _, agreement = score_and_evaluate(kept_pairs(spark, sf_dir), "op-all-02", gold=gold)
    return agreement


# ------------------------------------------------------------------ M5-M7, T5, E6


def _ensembled(spark, sf_dir):
    """J6 members (embedding, reversed embedding) with their scores -> P11."""
    r = ad.embedding_records(spark, sf_dir)
    m0 = r.select("dialogue_id", F.lit(0).alias("member"), "embedding", "score")
    m1 = r.select("dialogue_id", F.lit(1).alias("member"), F.reverse("embedding").alias("embedding"), "score")
    ens = fe.ensemble_features(m0.unionByName(m1), 2, score="score")
    lab = r.select("dialogue_id", "vec_id", F.col("gold").alias("label"))
    data, _ = gd.drop_unlabelled(ens.join(lab, "dialogue_id"), "label")
    return data.withColumn("split", F.when(F.col("vec_id") % 5 == 0, "dev").otherwise("train"))


_REG_PARAMS = (0.0, 0.1, 1.0)


def _fit(spark, sf_dir):
    """Ridges on one feature (the first component): they have a closed form that
    SQL can check. All features are in E6 and in the network's query."""
    r = ad.embedding_records(spark, sf_dir)
    data, _ = gd.drop_unlabelled(r.select("dialogue_id", "vec_id", F.array(F.col("embedding")[0].cast("double")).alias("features"), F.col("gold").alias("label")), "label")
    train, dev = data.where(F.col("vec_id") % 5 != 0), data.where(F.col("vec_id") % 5 == 0)
    return train, dev, rg.fit_candidates(train, _REG_PARAMS)


#: The closed form: the penalty stands on the scale of the label's deviation.
_RIDGE = {
    "d": "SELECT dialogue_id, vec_id, CAST(embedding[1] AS DOUBLE) AS x, gold AS y FROM emb_records WHERE gold IS NOT NULL",
    "tm": "SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, covar_pop(x, y) AS cxy, var_pop(x) AS vx, count(*) AS n "
          "FROM d WHERE vec_id % 5 <> 0",
    "cand": "SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({r} AS DOUBLE))" for i, r in enumerate(_REG_PARAMS)) + ") AS v(candidate, reg_param)",
    "pr": "SELECT candidate, reg_param, n, dialogue_id, y, my + (cxy / sx) / (vx / (sx * sx) + reg_param / sy) * (x - mx) / sx AS p FROM d, tm, cand "
          "WHERE vec_id % 5 = 0",
    "rk": f"SELECT *, {avg_rank_sql('y', 'candidate')} AS gr, {avg_rank_sql('p', 'candidate')} AS pr FROM pr",
    "met": f"""SELECT candidate, reg_param, n, {corr_sql('gr', 'pr')} AS spearman, {corr_sql('y', 'p')} AS pearson,
       avg(abs(p - y) + ln(1 + exp(-2 * abs(p - y))) - ln(2)) AS log_cosh FROM rk GROUP BY candidate, reg_param, n""",
    "best": "SELECT *, row_number() OVER (ORDER BY round(spearman, 9) DESC, candidate) AS position FROM met",
}


def _ridge_sql(body: str) -> str:
    return sql(body, "emb_records", extra=_RIDGE)


@query("M5_train_regressor", _ridge_sql("""SELECT reg_param, n AS n_train, true AS converged, round(spearman, 6) AS dev_spearman,
       round(pearson, 6) AS dev_pearson, round(log_cosh, 6) AS dev_log_cosh FROM met"""))
def m5(spark, sf_dir):
    """Fit one ridge per regularisation value; dev metrics of all in one pass."""
    train, dev, models = _fit(spark, sf_dir)
    table = spark.createDataFrame([(i, m.reg_param, m.converged) for i, m in enumerate(models)],
                                  "candidate int, reg_param double, converged boolean")
    n_train = train.agg(F.count(F.lit(1)).alias("n_train"))
    met = rg.evaluate_candidates(models, dev)
    return met.join(F.broadcast(table), "candidate").join(F.broadcast(n_train)).select(
        "reg_param", "n_train", "converged", F.col("spearman").alias("dev_spearman"), F.col("pearson").alias("dev_pearson"),
        F.col("log_cosh").alias("dev_log_cosh"))


@query("T5_best_model", _ridge_sql("SELECT CAST(position AS INTEGER) AS position, reg_param, round(spearman, 6) AS dev_spearman FROM best WHERE position <= 2"))
def t5(spark, sf_dir):
    """Keep the two best candidates by dev Spearman (ties: the first)."""
    _, dev, models = _fit(spark, sf_dir)
    best = rg.select_best(models, dev, 2)
    return spark.createDataFrame([(i + 1, m.reg_param, float(s)) for i, (m, s) in enumerate(best)],
                                 "position int, reg_param double, dev_spearman double")


@query("M6_predict_regressor", _ridge_sql("""SELECT dialogue_id, round(p, 6) AS prediction, round(y, 6) AS gold FROM pr
WHERE candidate = (SELECT candidate FROM best WHERE position = 1)"""))
def m6(spark, sf_dir):
    """Predictions of the best model on the dev split with real gold."""
    _, dev, models = _fit(spark, sf_dir)
    return rg.predict(rg.select_best(models, dev, 1)[0][0], dev)


@query("M7_rank_evaluator", _ridge_sql("""SELECT v.metric, round(CASE WHEN v.metric = 'pearson' THEN b.pearson WHEN v.metric = 'log_cosh' THEN b.log_cosh ELSE b.spearman END, 6) AS value,
       v.metric <> 'log_cosh' AS larger_is_better
FROM (SELECT unnest(['evaluator_spearman', 'grouped_spearman', 'spearman', 'pearson', 'log_cosh']) AS metric) v, best b WHERE b.position = 1"""))
def m7(spark, sf_dir):
    """The custom evaluator's three metrics for the best model on dev."""
    _, dev, models = _fit(spark, sf_dir)
    best, value = rg.select_best(models, dev, 1)[0]
    pred = best.transform(dev)
    ev = rg.RankCorrelationEvaluator("spearman")
    met = rg.dev_metrics(pred)
    rows = [("evaluator_spearman", ev.evaluate(pred), ev.isLargerBetter()), ("grouped_spearman", value, True)]
    rows += [(k, v, k != "log_cosh") for k, v in met.items()]
    return spark.createDataFrame(rows, "metric string, value double, larger_is_better boolean")


@query("M5_network_regressor")
def m5_network(spark, sf_dir):
    """The network on the ensembled embeddings: dev metrics after training, beside a ridge's."""
    from turnscore.operators import network as nw

    data = _ensembled(spark, sf_dir)
    train, dev = data.where(F.col("split") == "train"), data.where(F.col("split") == "dev")
    net = nw.fit_network(train, dev, hidden=(32,), rounds=2, steps=20)
    models = [*rg.fit_candidates(train, (1.0,)), net]
    met = rg.evaluate_candidates(models, dev)
    names = spark.createDataFrame([(i, m.name) for i, m in enumerate(models)], "candidate int, model string")
    return met.join(F.broadcast(names), "candidate").select("model", "n", "spearman", "pearson", "log_cosh")


@query("E6_train_on_embeddings")
def e6(spark, sf_dir):
    """Whole job: pool train sets of dialogue rows, drop rows whose context
    occurs in dev, embed responses, store and reload the embeddings, ensemble,
    drop unlabelled, fit candidates, keep the best by dev Spearman, predict
    dev (gold: the appropriateness rating)."""
    from turnscore.plans.jobs import embed_and_train
    from turnscore.session import scratch_path

    d = ad.dialogue_rows(spark, sf_dir)
    dev = d.where(F.col("conv_id") % 5 == 0).select("dialogue_id", "context", "response")
    rest = d.where(F.col("conv_id") % 5 != 0)
    sets = {f"train-{k}": rest.where(F.col("conv_id") % 3 == k).select("dialogue_id", "context", "response")
            for k in range(3)}
    gold = ad.turns(spark, sf_dir).select(F.col("uid").alias("dialogue_id"), ad.gold_expr(0).alias("label"))
    return embed_and_train(sets, dev, gold, scratch_path(spark, "e6-embeddings"))
