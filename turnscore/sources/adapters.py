"""Map the driver's read-only tables onto the reference's data model.

The reference reads challenge files (test turns, turn gold, dialogue JSON,
scored CSVs, vector stores). Those files are not available, so these
adapters derive the same shapes from ``conversations``, ``embeddings``,
``documents`` and ``labels`` with the deterministic recipes of FIXTURES.md
section 2.1. Every adapter is a lazy DataFrame over the given tables, so the
work of every query grows with them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.schemas import QUALITIES
from turnscore.session import sf_table
from turnscore.sources.catalogue import DATASET_NAMES, catalogue, catalogue_rows

LANGS = ("EN", "ZH", "ES")


def quality_rows() -> Column:
    """Array of (qi, quality) structs; ``inline`` it to fan rows out per
    quality without a join."""
    return F.array(
        *[F.struct(F.lit(i).alias("qi"), F.lit(q).alias("quality")) for i, q in enumerate(QUALITIES)]
    )


def uid_expr(dialogue: Column | str = "conv_id", turn: Column | str = "turn") -> Column:
    return F.format_string("TEST-%04d-%04d", dialogue, turn)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test turns with the gold file's slice columns, one row per turn."""
    c = sf_table(spark, sf_dir, "conversations")
    return c.select(
        uid_expr().alias("uid"),
        F.col("conv_id").alias("dialogue_id"),
        F.col("turn").alias("turn_id"),
        F.when(F.col("role") == "assistant", "Chatbot").otherwise("User").alias("sid"),
        F.concat(F.lit("DS"), (F.col("conv_id") % 4).cast("string")).alias("cid"),
        F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("conv_id") % 3 + 1).cast("int")).alias(
            "language"
        ),
        F.when(F.col("conv_id") % 2 == 0, "YES").otherwise("NO").alias("supervised"),
        F.col("role"),
        F.col("text"),
    )


def rating(k: int, qi: int | str = "qi", dialogue: str = "dialogue_id", turn: str = "turn_id",
           text: str = "text") -> Column:
    """Annotator ``k``'s rating of quality index ``qi`` (a column name or a
    number), 1..5 as double. Written as one SQL expression (one call to the
    JVM instead of one per operator)."""
    return F.expr(
        f"CAST(1 + ({dialogue} * 7 + {turn} * 13 + {k * 5} + {qi} * 11 + length({text}) * {k + 1}) % 5 AS DOUBLE)"
    )


def score_tenths(qi: int | str = "qi") -> Column:
    """Synthetic prediction in tenths: 10..50."""
    return F.expr(f"(10 + (length(text) * 3 + dialogue_id * 5 + {qi} * 7) % 41)")


def ratings_long(turns_df: DataFrame) -> DataFrame:
    """One row per (turn, quality): three annotator ratings, gold, score."""
    t = turns_df.select("*", F.inline(quality_rows()))
    r = [rating(k) for k in range(3)]
    return t.select(
        "uid", "dialogue_id", "turn_id", "sid", "cid", "language", "supervised", "text", "qi", "quality",
        r[0].alias("r0"), r[1].alias("r1"), r[2].alias("r2"),
        gold_expr("qi").alias("gold"),
        (score_tenths() / 10).alias("score"),
    )


def gold_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long gold table ``(uid, quality, gold)`` plus slice columns."""
    return ratings_long(turns(spark, sf_dir)).select(
        "uid", "dialogue_id", "turn_id", "sid", "cid", "language", "supervised", "quality", "gold"
    )


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table ``(uid, quality, score)``."""
    return ratings_long(turns(spark, sf_dir)).select("uid", "quality", "score")


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and score side by side, one row per (turn, quality)."""
    return ratings_long(turns(spark, sf_dir))


def gold_expr(qi: int | str) -> Column:
    """Gold of quality index ``qi`` for a turn row: mean of the three ratings,
    NULL when ``(conv_id + turn + qi) % 11 = 0``."""
    r = [
        f"CAST(1 + (dialogue_id * 7 + turn_id * 13 + {k * 5} + {qi} * 11 + length(text) * {k + 1}) % 5 AS DOUBLE)"
        for k in range(3)
    ]
    return F.expr(f"CASE WHEN (dialogue_id + turn_id + {qi}) % 11 <> 0 THEN ({r[0]} + {r[1]} + {r[2]}) / 3 END")


def turn_gold_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The challenge's turn gold file: UID, UID_TEST, CID, SID, SUPERVISED,
    LANGUAGE and the four dimensions (row-wise, no pivot)."""
    from turnscore.schemas import TURN_DIMENSIONS

    t = turns(spark, sf_dir)
    return t.select(
        F.col("uid").alias("UID"),
        F.col("uid").alias("UID_TEST"),
        F.col("cid").alias("CID"),
        F.col("sid").alias("SID"),
        F.col("supervised").alias("SUPERVISED"),
        F.col("language").alias("LANGUAGE"),
        *[gold_expr(i).alias(d) for i, d in enumerate(TURN_DIMENSIONS)],
    )


def scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: the four synthetic scores as columns named by quality,
    computed row-wise (no pivot, no shuffle)."""
    t = turns(spark, sf_dir)
    return t.select(
        "uid", "dialogue_id", "turn_id", "sid", "text",
        *[(score_tenths(i) / 10).alias(q) for i, q in enumerate(QUALITIES)],
    )


def submission_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A participant submission: UID + four dimensions (the synthetic scores).
    Every 19th turn is left out, as a careless participant would."""
    from turnscore.schemas import TURN_DIMENSIONS

    s = scores_wide(spark, sf_dir).where((F.col("dialogue_id") + F.col("turn_id")) % 19 != 0)
    return s.select(F.col("uid").alias("UID"), *[F.col(q).alias(d) for q, d in zip(QUALITIES, TURN_DIMENSIONS)])


def _num_text(tenths: Column) -> Column:
    """Render tenths as ``d.d`` text with integer arithmetic only."""
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic raw model replies in six shapes (by ``(conv_id + turn) % 6``)."""
    t = turns(spark, sf_dir)
    s = [_num_text(score_tenths(i)) for i in range(4)]
    kind = (F.col("dialogue_id") + F.col("turn_id")) % 6
    reply = (
        F.when(kind == 0, F.concat(F.lit("appropriateness: "), s[0], F.lit(", richness: "), s[1],
                                   F.lit(", grammatical: "), s[2], F.lit(", relevance: "), s[3]))
        .when(kind == 1, F.concat(s[0], F.lit(" because the reply fits the context")))
        .when(kind == 2, F.lit("the reply reads well and stays on topic"))
        .when(kind == 3, F.concat(F.lit("Appropriateness|"), s[0], F.lit(";richness;;"), s[1],
                                  F.lit("\tgrammatical?"), s[2], F.lit(" relevance:")))
        .when(kind == 4, F.concat(F.lit("relevance is about "), s[3], F.lit("! appropriateness roughly "),
                                  s[0], F.lit("!")))
        .otherwise(F.lit(""))
    )
    return t.select("uid", "dialogue_id", "turn_id", "sid", "text", reply.alias("reply"))


def dialogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue dataset rows (S1 shape, flat): one row per turn with its raw
    history as ``context`` and the turn as ``response``, language variants,
    and a catalogue dataset assigned by ``conv_id % 24``."""
    from turnscore.operators.dialogues import dialogue_context

    # raw history (not trimmed), blocked against hot dialogues
    t = dialogue_context(turns(spark, sf_dir), "dialogue_id", "turn_id", "text", out="context", trim=False)
    ctx = F.col("context")
    resp = F.when((F.col("dialogue_id") + F.col("turn_id")) % 17 == 0, F.lit("")).otherwise(F.col("text"))
    names = F.array(*[F.lit(n) for n in DATASET_NAMES])
    base = t.select(
        "uid", "dialogue_id", "turn_id", "sid", "text",
        F.element_at(names, (F.col("dialogue_id") % len(DATASET_NAMES) + 1).cast("int")).alias("dataset"),
        F.concat(F.lit("model-"), (F.col("dialogue_id") % 5).cast("string")).alias("model"),
        ctx.alias("context"),
        resp.alias("response"),
    )
    return base.select(
        F.col("uid").alias("dialogue_id"),
        F.col("dialogue_id").alias("conv_id"),
        "turn_id", "sid", "text", "dataset", "model", "context", "response",
        F.concat(F.lit("[zh] "), "context").alias("context_zh"),
        F.concat(F.lit("[es] "), "context").alias("context_es"),
        F.concat(F.lit(" "), "context", F.lit(" ")).alias("context_pa"),
        F.concat(F.lit("[zh] "), "response").alias("response_zh"),
        F.concat(F.lit("[es] "), "response").alias("response_es"),
        F.concat(F.lit("\u3000  "), "response", F.lit("\t\u3000")).alias("response_pa"),
    )


def dialogue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogue rows' keys and catalogue dataset without the history
    (for rating work that never reads the context)."""
    t = turns(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in DATASET_NAMES])
    return t.select(
        F.col("uid").alias("dialogue_id"),
        F.col("dialogue_id").alias("conv_id"),
        "turn_id", "text",
        F.element_at(names, (F.col("dialogue_id") % len(DATASET_NAMES) + 1).cast("int")).alias("dataset"),
    )


def annotation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long annotator lists: ``(dialogue_id, dataset, annotation, position,
    rule, ratings)``; the list is empty when
    ``(conv_id + turn + position) % 11 = 0``. The catalogue side is a fixed
    107-row table, broadcast by construction."""
    rows = dialogue_keys(spark, sf_dir)
    cat = F.broadcast(catalogue(spark).select("dataset", "annotation", "position", "rule"))
    j = rows.join(cat, "dataset")
    r = [rating(k, "position", dialogue="conv_id") for k in range(3)]
    empty = (F.col("conv_id") + F.col("turn_id") + F.col("position")) % 11 == 0
    ratings = F.when(empty, F.array().cast("array<double>")).otherwise(F.array(*r))
    return j.select("dialogue_id", "conv_id", "turn_id", "dataset", "annotation", "position", "rule",
                    ratings.alias("ratings"))


def annotation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset rows with their annotator lists inside: ``(dialogue_id, model,
    dataset, rule, ratings)``, ``ratings`` a map by annotation. As in real files
    ids repeat: every 13th dialogue was answered by a second model and rated
    anew, every 17th stands in the file twice, equal in all."""
    known: dict[str, dict] = {}
    for _, dataset, rule, annotation, position, *_ in catalogue_rows():
        known.setdefault(dataset, {"rule": rule, "of": []})["of"].append({"annotation": annotation, "position": position})
    cat = F.from_json(F.lit(json.dumps(known)), "map<string,struct<rule:string,of:array<struct<annotation:string,position:int>>>>")
    rows = dialogue_keys(spark, sf_dir).withColumn("model", F.concat(F.lit("model-"), (F.col("conv_id") % 5).cast("string")))
    twice = F.when(F.col("conv_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("conv_id") % 17 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    rows = rows.select("*", F.explode(twice).alias("again"), F.try_element_at(cat, F.col("dataset")).alias("_cat"))
    rows = rows.withColumn("model", F.when(F.col("again") == 1, "model-x").otherwise(F.col("model"))).withColumn("turn_id", F.col("turn_id") + F.col("again"))
    r = [f"CAST(1 + (conv_id * 7 + turn_id * 13 + {k * 5} + a.position * 11 + length(text) * {k + 1}) % 5 AS DOUBLE)" for k in range(3)]
    lists = F.expr(f"""map_from_entries(transform(_cat.of, a -> struct(a.annotation AS k, CASE WHEN (conv_id + turn_id + a.position) % 11 = 0
        THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array({', '.join(r)}) END AS v)))""")
    return rows.select("dialogue_id", "model", "dataset", F.col("_cat.rule").alias("rule"), lists.alias("ratings"))


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission file as it is: the rows of :func:`submission_wide`, every
    7th turn a second time with other scores further down, and each row's place."""
    from turnscore.schemas import TURN_DIMENSIONS

    s = scores_wide(spark, sf_dir).where((F.col("dialogue_id") + F.col("turn_id")) % 19 != 0)
    again = F.when((F.col("dialogue_id") + F.col("turn_id")) % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    s = s.select("*", F.explode(again).alias("_again"))
    place = F.struct(F.lit("submission.csv").alias("file"), F.lit(0).cast("long").alias("block"),
                     ((F.col("dialogue_id") * 100 + F.col("turn_id")) * 2 + F.col("_again")).alias("row"))
    return s.select(F.col("uid").alias("UID"), *[F.when(F.col("_again") == 0, F.col(q)).otherwise(5.5 - F.col(q)).alias(d) for q, d in zip(QUALITIES, TURN_DIMENSIONS)],
                    place.alias("_place"))


def rehearsal_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rehearsal CSV shape: id, sid, response, paraphrase ratings p_*, original
    ratings o_* (NULL when ``conv_id % 5 = 0``)."""
    t = turns(spark, sf_dir)
    short = ("appr", "cont", "gram", "rel")
    missing = F.col("dialogue_id") % 5 == 0
    return t.select(
        F.col("uid").alias("id"),
        F.col("sid"),
        F.col("text").alias("response"),
        *[rating(0, i).alias(f"p_{s}") for i, s in enumerate(short)],
        *[F.when(~missing, rating(1, i)).alias(f"o_{s}") for i, s in enumerate(short)],
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector store of rated examples: ``(ex_id, embedding, context, response,
    qualities map)``. Even labels carry all four qualities; odd ones lack
    ``relevance``."""
    e = sf_table(spark, sf_dir, "embeddings")
    lab = F.col("label")
    vals = [(F.lit(1) + (lab + i) % 5).cast("double") for i in range(4)]
    m = F.create_map(
        F.lit("appropriateness"), vals[0],
        F.lit("richness"), vals[1],
        F.lit("grammatical"), vals[2],
        F.lit("relevance"), F.when(lab % 2 == 0, vals[3]),
    )
    return e.select(
        F.col("vec_id").alias("ex_id"),
        "embedding",
        F.concat(F.lit("context of example "), F.col("vec_id").cast("string")).alias("context"),
        F.concat(F.lit("response of example "), F.col("vec_id").cast("string")).alias("response"),
        F.map_filter(m, lambda k, v: v.isNotNull()).alias("qualities"),
        "label",
    )


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors: every embedding of the table (each query excludes
    itself from its neighbours)."""
    e = sf_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), "embedding")


def embedding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding records (1.9): id, embedding, predicted score, gold.
    Gold is NULL when ``label = 0`` (unlabelled records)."""
    e = sf_table(spark, sf_dir, "embeddings")
    return e.select(
        F.format_string("EMB-%05d", "vec_id").alias("dialogue_id"),
        "vec_id",
        "embedding",
        (F.lit(1) + (F.col("vec_id") * 7 % 41) / 10).alias("score"),
        F.when(F.col("label") != 0, (F.lit(1) + F.col("label") % 5).cast("double")).alias("gold"),
        "label",
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second natural gold table: labels joined with documents (gold =
    ``quality``, predictor = ``n_chars``, slices ``lang`` and ``source``)."""
    lab = sf_table(spark, sf_dir, "labels")
    doc = sf_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", "lang", "source",
        F.col("quality").cast("double").alias("gold"),
        F.col("n_chars").cast("double").alias("score"),
    )
