"""Registered retrieval queries: J9-J12, T4, F2."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.functions import prompts
from turnscore.operators import retrieval as rt
from turnscore.plans.oracle import lit_sql, sql
from turnscore.plans.registry import query
from turnscore.schemas import QUALITIES
from turnscore.sources import adapters as ad

_PROMPT = prompts.get_prompt("vh-relevance-2egs-dd-zhao-retrieval-01")
N = _PROMPT.n_examples
WANTED = _PROMPT.qualities

_DIST = """SELECT q.query_id, s.ex_id, s.q_relevance, s.q_appropriateness,
       list_sum(list_transform(range(len(s.embedding)), lambda i:
         (CAST(q.qvec[i + 1] AS DOUBLE) - CAST(s.embedding[i + 1] AS DOUBLE)) *
         (CAST(q.qvec[i + 1] AS DOUBLE) - CAST(s.embedding[i + 1] AS DOUBLE)))) AS dist
FROM rq q JOIN store s ON s.ex_id <> q.query_id"""
_NEAR = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ex_id) AS rk FROM dist"
_CHOSEN = f"""SELECT query_id, ex_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rank
FROM near WHERE rk <= {3 * N} AND q_relevance IS NOT NULL QUALIFY rank <= {N}"""
_FILL = f"""SELECT query_id, ex_id, dist, rank, 'store' AS source FROM chosen
UNION ALL
SELECT b.query_id, b.ex_id, b.dist, CAST(h.have + row_number() OVER (PARTITION BY b.query_id ORDER BY b.dist, b.ex_id)
       AS BIGINT) AS rank, 'backup'
FROM near b JOIN (SELECT q.query_id, coalesce(c.have, 0) AS have FROM rq q
                  LEFT JOIN (SELECT query_id, count(*) AS have FROM chosen GROUP BY query_id) c
                  ON c.query_id = q.query_id) h ON h.query_id = b.query_id
WHERE h.have < {N} AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = b.query_id AND c.ex_id = b.ex_id)
QUALIFY rank <= {N}"""
_RET = {"dist": _DIST, "near": _NEAR, "chosen": _CHOSEN, "filled": _FILL}


def _chosen(spark, sf_dir):
    q = ad.retrieval_queries(spark, sf_dir)
    s = ad.store(spark, sf_dir)
    return q, s, rt.similar_examples(q, s, N, WANTED)


@query(
    "J9_similar_examples",
    sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, ex_id, round(dist, 6) AS dist FROM chosen", "store", "rq",
        extra={k: _RET[k] for k in ("dist", "near", "chosen")}),
)
def j9(spark, sf_dir):
    return _chosen(spark, sf_dir)[2]


def _filled(spark, sf_dir):
    s = ad.store(spark, sf_dir)
    return s, rt.with_backup(ad.retrieval_queries(spark, sf_dir), s, N, WANTED)


@query(
    "J10_backup_fill",
    sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, ex_id, round(dist, 6) AS dist, source FROM filled",
        "store", "rq", extra=_RET),
)
def j10(spark, sf_dir):
    return _filled(spark, sf_dir)[1]


_PAY = """SELECT f.query_id, CAST(f.rank AS INTEGER) AS rank, f.ex_id, round(f.dist, 6) AS dist, f.source,
       s.context, s.response, s.q_relevance AS relevance
FROM filled f JOIN store s ON s.ex_id = f.ex_id"""


@query("J11_example_payload", sql("SELECT * FROM pay", "store", "rq", extra={**_RET, "pay": _PAY}))
def j11(spark, sf_dir):
    s, filled = _filled(spark, sf_dir)
    return rt.example_payload(filled, s, WANTED)


def _example_sql(prompt, ctx: str, resp: str, ratings: dict[str, str]) -> str:
    from turnscore.functions.prompts import _split_example

    pieces = []
    for kind, x in _split_example(prompt.example_template):
        if kind == "lit":
            pieces.append(lit_sql(x))
        elif x == "dialogue_context":
            pieces.append(ctx)
        elif x == "response":
            pieces.append(resp)
        else:
            pieces.append(f"coalesce(CAST({ratings[x]} AS VARCHAR), 'n/a')")
    return "(" + " || ".join(pieces) + ")"


def _block_sql(agg: str) -> str:
    head, tail = prompts.EXAMPLE_BLOCK.split("{positive_examples}")
    return f"{lit_sql(head)} || {agg} || {lit_sql(tail)}"


_F2_TEXT = _example_sql(_PROMPT, "context", "response", {"relevance": "relevance"})


@query(
    "F2_render_examples",
    sql(f"""SELECT query_id, {_block_sql(f"string_agg({_F2_TEXT}, {lit_sql(prompts.EXAMPLE_SEPARATOR)} ORDER BY rank)")}
       AS examples FROM pay GROUP BY query_id""", "store", "rq", extra={**_RET, "pay": _PAY}),
)
def f2(spark, sf_dir):
    s, filled = _filled(spark, sf_dir)
    pay = rt.example_payload(filled, s, WANTED)
    text = prompts.render_example(_PROMPT, F.col("context"), F.col("response"), {q: F.col(q) for q in WANTED})
    return prompts.examples_block(pay.withColumn("_text", text), ["query_id"], "rank", "_text")


_ALL4 = " AND ".join(f"q_{q} IS NOT NULL" for q in QUALITIES)


@query(
    "T4_sample_examples",
    sql(f"""SELECT ex_id, md5('42|' || CAST(ex_id AS VARCHAR)) AS sample_key FROM store WHERE {_ALL4}
ORDER BY sample_key, ex_id LIMIT 5""", "store"),
)
def t4(spark, sf_dir):
    s = ad.store(spark, sf_dir).where(rt.has_qualities("qualities", QUALITIES))
    return rt.sample_examples(s, 5, 42).select("ex_id", "sample_key")


_STATIC = prompts.get_prompt("op-all-egs-rehearsal-copy-hard5-02")
_ST_TEXT = _example_sql(_STATIC, "context", "response", {q: f"q_{q}" for q in QUALITIES})


@query(
    "J12_static_examples",
    sql(f"""SELECT t.uid, b.examples FROM turns t, (
  SELECT {_block_sql(f"string_agg({_ST_TEXT}, {lit_sql(prompts.EXAMPLE_SEPARATOR)} ORDER BY sample_key, ex_id)")}
         AS examples
  FROM (SELECT *, md5('42|' || CAST(ex_id AS VARCHAR)) AS sample_key FROM store WHERE {_ALL4}
        ORDER BY sample_key, ex_id LIMIT 5)) b""", "turns", "store"),
)
def j12(spark, sf_dir):
    """The same sampled examples attached to every turn. The block is
    at most n examples, so it is built once and attached as a literal."""
    s = ad.store(spark, sf_dir).where(rt.has_qualities("qualities", QUALITIES))
    sample = rt.sample_examples(s, _STATIC.n_examples, 42)
    ratings = {q: F.try_element_at(F.col("qualities"), F.lit(q)) for q in QUALITIES}
    text = prompts.render_example(_STATIC, F.col("context"), F.col("response"), ratings)
    block = prompts.examples_block(sample.withColumn("_text", text).withColumn("_g", F.lit(0)), ["_g"],
                                   "sample_key", "_text")
    value = block.first()["examples"]  # one bounded row (n examples)
    t = ad.turns(spark, sf_dir)
    return t.select("uid", F.lit(value).alias("examples"))
