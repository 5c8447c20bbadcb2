"""Unit tests on hand-made rows (FIXTURES.md 2.2) against brute force."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from turnscore.functions import prompts, replies
from turnscore.functions.stats import correlation_pvalue
from turnscore.operators import agreement as ag
from turnscore.operators import dialogues as dl
from turnscore.operators import gold as gd
from turnscore.operators import ranks
from turnscore.operators import retrieval as rt
from turnscore.operators import submissions as sb
from turnscore.schemas import QUALITIES

NAMES = set(QUALITIES)


def brute_value(reply: str, quality: str, single: bool):
    """Documented reply semantics, written out plainly for testing."""
    if single:
        toks = reply.split()
        if toks:
            try:
                return float(toks[0])
            except ValueError:
                pass
    words = re.split("[:;|,!? \t\n]", reply.lower())
    if quality not in words:
        return None
    for w in words[words.index(quality) + 1:]:
        if w in NAMES:
            return None
        try:
            return float(w)
        except ValueError:
            continue
    return None


REPLIES = ["4", "4.5 because", "4,", "5d", "1_0", "nan", "", "relevance 2 relevance 4",
           "appropriateness: 3.5, richness: 2", "Richness|4;grammatical 5! relevance", "appropriateness relevance 3",
           "grammatical: .5e1", "relevance:\t-2"]


def test_parse_replies_match_brute_force(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "uid int, reply string")
    for qs in (QUALITIES, ("appropriateness",)):
        got = {(r["uid"], r["quality"]): r for r in replies.parse_replies(df, qs, "reply").collect()}
        for i, text in enumerate(REPLIES):
            for q in qs:
                want = brute_value(text, q, len(qs) == 1)
                row = got[(i, q)]
                if want is None:
                    assert row["parse_error"] == 1 and row["score"] == 3.0, (text, q)
                elif math.isnan(want):
                    assert math.isnan(row["score"]) and row["parse_error"] == 0
                else:
                    assert row["score"] == pytest.approx(want) and row["parse_error"] == 0, (text, q, row)


def test_default_zero_is_respected(spark):
    df = spark.createDataFrame([(1, "no numbers")], "uid int, reply string")
    row = replies.parse_replies(df, QUALITIES, "reply", default=0.0).first()
    assert row["score"] == 0.0


def brute_avg_rank(values):
    order = sorted(values)
    out = {}
    for v in set(values):
        below = sum(1 for x in order if x < v)
        ties = sum(1 for x in order if x == v)
        out[v] = below + (ties + 1) / 2
    return [out[v] for v in values]


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_average_rank_matches_brute_force(spark, buckets):
    rnd = random.Random(7)
    rows = [(g, i, float(rnd.choice([1, 2, 2.5, 3, 3, 4, -1, 0, 1e-3, 5, 100]))) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    got = {(r["g"], r["i"]): r["rank"] for r in ranks.average_rank(df, "v", ["g"], "rank", buckets).collect()}
    for g in range(3):
        vals = [v for gg, _, v in rows if gg == g]
        want = brute_avg_rank(vals)
        for (gg, i, _), w in zip([r for r in rows if r[0] == g], want):
            assert got[(gg, i)] == pytest.approx(w)
    total = sum(got[(0, i)] for i in range(40))
    assert total == pytest.approx(40 * 41 / 2)


def test_global_rank_and_nulls(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 3.0), (4, 1.0)], "i int, v double")
    got = {r["i"]: r["rank"] for r in ranks.average_rank(df, "v", (), "rank").collect()}
    assert got == {1: 2.5, 2: None, 3: 2.5, 4: 1.0}


def test_correlation_edge_cases(spark):
    rows = [("const", 1.0, 3.0), ("const", 2.0, 3.0), ("const", 4.0, 3.0),
            ("one", 1.0, 2.0), ("ties", 2.0, 2.0), ("ties", 2.0, 2.0),
            ("ok", 1.0, 1.0), ("ok", 2.0, 3.0), ("ok", 3.0, 2.0), ("ok", None, 5.0), ("ok", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "q string, gold double, score double")
    got = {r["q"]: r for r in ag.correlations(df, ["q"]).collect()}
    assert got["const"]["pearson"] is None and got["const"]["spearman"] is None
    assert got["one"]["pearson"] is None
    assert got["ties"]["spearman"] is None
    assert got["ok"]["n"] == 3
    assert got["ok"]["pearson"] == pytest.approx(0.5)
    assert got["ok"]["spearman"] == pytest.approx(0.5)
    mm = ag.macro_mean(ag.correlations(df, ["q"])).first()
    assert mm["n_undefined"] == 3 and mm["pearson_mean"] == pytest.approx(0.5)


def test_pvalue_columns_equal_plain_python(spark):
    from turnscore.functions.stats import pvalue

    rows = [(r, n) for r in (0.0, 1e-9, -1e-3, 0.01, 0.1, -0.3, 0.5, 0.9, -0.999, 1 - 1e-12, 1.0, -1.0) for n in (2, 3, 4, 5, 10, 47, 500, 9999, 100_001, 100_002, 10**7, 10**12)]
    df = spark.createDataFrame([*rows, (None, 10), (float("nan"), 10), (0.5, None)], "r double, n long")
    out = df.select("r", "n", pvalue(F.col("r"), F.col("n")).alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for x in out.collect():
        want = correlation_pvalue(x["r"], x["n"]) if x["r"] is not None and x["n"] is not None else None
        # plain Python loses the last digits of 1 - r * r next to 1
        assert x["p"] == (None if want is None else pytest.approx(want, rel=1e-7, abs=3e-7)), (x, want)


def test_pvalue():
    assert correlation_pvalue(0.5, 10) == pytest.approx(0.14111, abs=1e-5)
    assert correlation_pvalue(0.0, 30) == pytest.approx(1.0)
    assert correlation_pvalue(0.3, 2) is None


def brute_tags(ctx: str) -> str:
    lines = ctx.strip().split("\n")
    n = len(lines)
    return "\n".join(("A: " if (n - 1 - i) % 2 == 0 else "B: ") + t for i, t in enumerate(lines))


def test_speaker_tags(spark):
    cases = ["one line", "", "a\nb\nc", "a\n\nb", "  x\ny  \n"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r[0] for r in df.select(dl.speaker_tags("c")).collect()]
    assert got == [brute_tags(c) for c in cases]
    assert got[1] == "A: "


def test_dialogue_context_and_segments(spark):
    rows = [(1, t, f"t{t} ") for t in (0, 1, 9, 10, 11)] + [(2, 3, "x"), (2, 4, "y")]
    df = spark.createDataFrame(rows, "d int, turn int, text string")
    w1 = {(r["d"], r["turn"]): r["context"] for r in dl.dialogue_context(df, "d", "turn").collect()}
    assert w1[(1, 0)] == "" and w1[(1, 10)] == "t0\nt1\nt9" and w1[(2, 4)] == "x"
    seg = df.withColumn("label", F.col("turn").cast("string"))
    w2 = {(r["d"], r["turn"]): r for r in dl.segment_context(seg, "d", "turn", "label", "text").collect()}
    assert w2[(1, 10)]["is_first"] and w2[(1, 10)]["context"] == ""
    assert w2[(1, 11)]["context"] == "t10 "
    assert w2[(1, 9)]["context"] == "t0 \nt1 "
    assert w2[(2, 4)]["context"] == "x"  # no reset turn: no leak from dialogue 1
    strict = dl.segment_context(seg, "d", "turn", "label", "text", strict=True)
    assert {r["turn"] for r in strict.where("is_first").collect()} == {0}


def test_annotator_and_composite(spark):
    rows = [("d1", "persona-see", "first", "enjoy", [4.0, 1.0]), ("d1", "persona-see", "first", "avoid_rep", [2.0]),
            ("d1", "persona-see", "first", "fluency", [3.0]), ("d1", "persona-see", "first", "inquisitive", [5.0]),
            ("d2", "fed-turn", "mean", "Understandable", [1.0, 2.0, 3.0]), ("d2", "fed-turn", "mean", "Fluent", []),
            ("d3", "fed-turn", "mean", "Understandable", [4.0, 5.0]), ("d3", "fed-turn", "mean", "Fluent", [1.0])]
    df = spark.createDataFrame(rows, "dialogue_id string, dataset string, rule string, annotation string, "
                                     "ratings array<double>")
    vals = gd.annotator_aggregate(df)
    v = {(r["dialogue_id"], r["annotation"]): r["value"] for r in vals.collect()}
    assert v[("d1", "enjoy")] == 4.0 and v[("d2", "Understandable")] == 2.0 and v[("d2", "Fluent")] is None
    comp = {(r["dialogue_id"], r["quality"]): r["gold"] for r in gd.composite_quality(vals).collect()}
    # richness of persona-see: avoid_rep, enjoy, fluency, enjoy, inquisitive -> enjoy counts twice
    assert comp[("d1", "richness")] == pytest.approx((2 + 4 + 3 + 4 + 5) / 5)
    assert comp[("d2", "grammatical")] is None  # one source missing
    assert comp[("d3", "grammatical")] == pytest.approx((4.5 + 1.0) / 2)


def test_submission_merge_and_checks(spark):
    a = spark.createDataFrame([("u1", 1.0), ("u2", 2.0), ("u3", 3.0)], "UID string, v double")
    b = spark.createDataFrame([("u1", 1.0), ("u2", 2.0), ("u2", 2.5)], "UID string, v double")
    merged = sb.merge_quality_files({"APPROPRIATENESS": a, "CONTENT_RICHNESS": b})
    chk = sb.submission_checks(merged, 3).first()
    assert chk["n_duplicate_uids"] == 1 and chk["n_incomplete"] == 1 and not chk["ok"]
    diff = {(r["side"], r["UID"]) for r in sb.uid_difference(a, b).collect()}
    assert diff == {("left_only", "u3"), ("right_only", "u2")}


def test_prompt_placeholder_in_context(spark):
    p = prompts.get_prompt("vh-appropriateness-03")
    df = spark.createDataFrame([("ctx with {response} inside", "R")], "context string, response string")
    text = df.select(prompts.render_prompt(p).alias("t")).first()["t"]
    assert "ctx with {response} inside" in text and text.count("R") >= 1
    for name in prompts.PROMPTS:
        prompts.self_check(prompts.get_prompt(name))
    assert len(prompts.PROMPTS) == 27


def test_knn_and_backup_fill_match_brute_force(spark):
    rnd = random.Random(3)
    store_rows = [(i, [rnd.random() for _ in range(4)], f"c{i}", f"r{i}",
                   {"appropriateness": 1.0, **({"relevance": 2.0} if i % 3 == 0 else {})}) for i in range(60)]
    store = spark.createDataFrame(store_rows, "ex_id long, embedding array<double>, context string, response string, "
                                              "qualities map<string,double>")
    q = store.where("ex_id < 6").select(F.col("ex_id").alias("query_id"), "embedding")
    near = {(r["query_id"], r["rk"]): r["ex_id"] for r in rt.nearest(q, store, 5).collect()}
    vecs = {i: v for i, v, *_ in store_rows}
    for qi in range(6):
        d = sorted((sum((a - b) ** 2 for a, b in zip(vecs[qi], vecs[j])), j) for j in vecs if j != qi)
        assert [near[(qi, k)] for k in range(1, 6)] == [j for _, j in d[:5]]
    n = 4
    chosen = rt.similar_examples(q, store, n, ("relevance",))
    filled = rt.backup_fill(chosen, q, store, n).collect()
    per_q = {}
    for r in filled:
        per_q.setdefault(r["query_id"], []).append(r)
    for qi, rows in per_q.items():
        assert len(rows) == n and len({r["ex_id"] for r in rows}) == n
        assert sorted(r["rank"] for r in rows) == list(range(1, n + 1))


def test_rehearsal_variants(spark):
    rows = [("TEST-0001-0000", "User", "hi", 1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 1.0, 2.0),
            ("TEST-0001-0001", "Chatbot", "yo", 2.0, 2.0, 2.0, 2.0, None, None, None, None)]
    from turnscore.schemas import REHEARSAL_INPUT

    df = spark.createDataFrame(rows, REHEARSAL_INPUT)
    const = {r["dialogue_id"]: r for r in dl.rehearsal_rows(df, "constant").collect()}
    assert const["TEST-0001-0000"]["relevance"] == 5.0 and const["TEST-0001-0000"]["context"] == ""
    assert const["TEST-0001-0001"]["appropriateness"] == 2.0 and const["TEST-0001-0001"]["context"] == "hi"
    copy = {r["dialogue_id"]: r for r in dl.rehearsal_rows(df, "copy").collect()}
    assert copy["TEST-0001-0000"]["relevance"] == 2.0
    omit = dl.rehearsal_rows(df, "omit").collect()
    assert [r["dialogue_id"] for r in omit] == ["TEST-0001-0001"] and omit[0]["context"] == "hi"


def test_knn_ties_broken_by_id(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [5.0, 5.0]) for i in range(30)]
    store = spark.createDataFrame(rows, "ex_id long, embedding array<double>")
    q = spark.createDataFrame([(100, [1.0, 2.0]), (101, [5.0, 5.0])], "query_id long, embedding array<double>")
    got = {}
    for r in rt.nearest(q, store, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rk"], r["ex_id"], r["dist"]))
    assert [e for _, e, _ in sorted(got[100])] == [1, 2, 4, 5]
    assert [e for _, e, _ in sorted(got[101])] == [0, 3, 6, 9]
    assert all(d == 0.0 for _, _, d in got[100])


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocked_history_equals_plain_window(spark, block):
    rnd = random.Random(block)
    rows = [(d, t, rnd.choice(["a", " b ", "", "c\nd", "e"])) for d in range(6) for t in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "d int, turn int, text string")
    plain = {(r["d"], r["turn"]): r["context"] for r in dl.dialogue_context(df, "d", "turn", block_size=None).collect()}
    blocked = {(r["d"], r["turn"]): r["context"] for r in dl.dialogue_context(df, "d", "turn", block_size=block).collect()}
    assert plain == blocked


def test_null_prediction_is_masked_pairwise(spark):
    rows = [("q", 1.0, 1.0), ("q", 2.0, 3.0), ("q", 3.0, 2.0), ("q", 4.0, None), ("q", None, None)]
    df = spark.createDataFrame(rows, "q string, gold double, score double")
    r = ag.correlations(df, ["q"]).first()
    assert r["n"] == 3 and r["pearson"] == pytest.approx(0.5)
    rep = ag.mask_report(df, ["q"]).first()
    assert rep["n_gold"] == 4 and rep["n_dropped_pred"] == 1


def test_spearman_invariant_under_monotone_maps(spark):
    rnd = random.Random(11)
    rows = [(float(rnd.randint(1, 5)), rnd.random() * 4 + 1) for _ in range(60)]
    df = spark.createDataFrame([("a", g, s) for g, s in rows], "q string, gold double, score double")
    base = ag.correlations(df, ["q"]).first()["spearman"]
    mapped = df.withColumn("score", F.exp(F.col("score") * 3) - 7).withColumn("gold", F.col("gold") * 10 + 1)
    assert ag.correlations(mapped, ["q"]).first()["spearman"] == pytest.approx(base, abs=1e-12)


def test_history_is_incremental(spark):
    from tests.conftest import SMALL
    from turnscore.sources import adapters as ad

    t = dl.dialogue_context(ad.turns(spark, SMALL)).select("dialogue_id", "turn_id", "text", "context").collect()
    by = {(r["dialogue_id"], r["turn_id"]): r for r in t}
    for (d, k), r in by.items():
        nxt = by.get((d, k + 1))
        if nxt is not None:
            want = (r["context"] + "\n" if r["context"] != "" or k > 0 else "") + r["text"].strip()
            assert nxt["context"] == want


def test_retrieved_ids_unique_per_query(spark):
    from tests.conftest import SMALL
    from turnscore.sources import adapters as ad

    q, s = ad.retrieval_queries(spark, SMALL), ad.store(spark, SMALL)
    filled = rt.backup_fill(rt.similar_examples(q, s, 2, ("relevance",)), q, s, 2)
    dup = filled.groupBy("query_id", "ex_id").count().where("count > 1").count()
    self_hit = filled.where("query_id = ex_id").count()
    per_q = {r["query_id"]: r["count"] for r in filled.groupBy("query_id").count().collect()}
    assert dup == 0 and self_hit == 0 and set(per_q.values()) == {2} and len(per_q) == q.count()


@pytest.mark.parametrize("block", [None, 1, 2, 3])
def test_blocked_segments_equal_plain(spark, block):
    rnd = random.Random(5)
    rows = [(d, t, f"r{d}.{t}", str(t) if rnd.random() < 0.7 else str(t * 10)) for d in range(5)
            for t in range(rnd.randint(1, 12))]
    df = spark.createDataFrame(rows, "d int, turn int, response string, label string")
    plain = {(r["d"], r["turn"]): (r["segment"], r["context"], r["is_first"])
             for r in dl.segment_context(df, "d", "turn", "label", "response", block_size=None).collect()}
    got = {(r["d"], r["turn"]): (r["segment"], r["context"], r["is_first"])
           for r in dl.segment_context(df, "d", "turn", "label", "response", block_size=block).collect()}
    assert plain == got


def test_hot_dialogue_is_spread_over_blocks(spark):
    """Every turn of the table in one dialogue: the blocked history equals the
    plain window and is partitioned by (dialogue, block), not by dialogue."""
    from tests.conftest import SMALL
    from turnscore.sources import adapters as ad

    t = ad.turns(spark, SMALL).select(F.lit(0).alias("d"), (F.col("dialogue_id") * 100 + F.col("turn_id")).alias("k"),
                                      "text")
    plain = {r["k"]: r["context"] for r in dl.dialogue_context(t, "d", "k", block_size=None).collect()}
    blocked_df = dl.dialogue_context(t, "d", "k", block_size=100)
    assert {r["k"]: r["context"] for r in blocked_df.collect()} == plain
    n_blocks = t.select(F.floor(F.col("k") / 100)).distinct().count()
    assert n_blocks >= 10


def test_hot_group_with_narrow_values_ranks_exactly(spark):
    rnd = random.Random(9)
    hot = [("hot", 3.0 + rnd.random() * 0.2) for _ in range(300)]
    cold = [(f"g{i}", float(rnd.randint(1, 5))) for i in range(100)]
    df = spark.createDataFrame(hot + cold, "g string, v double")
    got = ranks.average_rank(df, "v", ["g"], "rank").where("g = 'hot'").collect()
    want = brute_avg_rank([v for _, v in hot])
    assert sorted(r["rank"] for r in got) == pytest.approx(sorted(want))
    counts = ranks.value_counts(df, "v", ["g"])
    bounds = ranks.sampled_bounds(counts, ["g", "v"], counts.count(), 8)
    ranges = counts.where("g = 'hot'").select(ranks.range_of(bounds, ["g", "v"]).alias("b")).distinct().count()
    assert ranges > 20
    cut = ranks.average_rank(df, "v", ["g"], "rank", 8).where("g = 'hot'").collect()
    assert sorted(r["rank"] for r in cut) == pytest.approx(sorted(want))


def test_label_coverage_reports_unmapped_datasets(spark):
    rows = spark.createDataFrame([("fed-dial",), ("fed-dial",), ("humod",)], "dataset string")
    gold = spark.createDataFrame([("x", "humod", "relevance", 3.0), ("y", "humod", "grammatical", None)],
                                 "dialogue_id string, dataset string, quality string, gold double")
    cov = {(r["dataset"], r["quality"]): r for r in gd.label_coverage(spark, gold, rows, QUALITIES).collect()}
    assert not any(cov[("fed-dial", q)]["mapped"] for q in QUALITIES)
    assert cov[("fed-dial", "relevance")]["n_missing"] == 2
    assert cov[("humod", "relevance")]["mapped"] and cov[("humod", "relevance")]["n_missing"] == 0
    assert cov[("humod", "grammatical")]["n_missing"] == 1 and not cov[("humod", "richness")]["mapped"]


def test_score_distribution_bins(spark):
    df = spark.createDataFrame([("q", 1.0, 5.0), ("q", 5.0, 0.0), ("q", None, 3.0)], "quality string, gold double, "
                                                                                       "score double")
    got = {(r["kind"], r["gold_bin"], r["pred_bin"]): r["n"] for r in ag.score_distribution(df, ["quality"]).collect()}
    assert got[("gold", 0, None)] == 1 and got[("gold", 31, None)] == 1
    assert got[("pred", None, 31)] == 1 and got[("pred", None, -1)] == 1 and got[("pred", None, 16)] == 1
    assert got[("joint", 0, 31)] == 1 and got[("joint", 31, -1)] == 1 and sum(got.values()) == 7


def test_parse_uid_routes_bad_prefixes(spark):
    df = spark.createDataFrame([("TEST-0001-0003",), ("DEV-0001-0003",), ("TEST-0001",), (None,)], "uid string")
    got = {r["uid"]: r for r in df.select("uid", *dl.parse_uid("uid")).collect()}
    assert got["TEST-0001-0003"]["prefix_ok"] and got["TEST-0001-0003"]["turn_last"] == "0003"
    assert not got["DEV-0001-0003"]["prefix_ok"] and not got["TEST-0001"]["prefix_ok"]
    kept = {r["uid"] for r in dl.drop_first_turns(spark.createDataFrame(
        [("TEST-0001-0000",), ("TEST-0001-0010",), (None,)], "uid string")).collect()}
    assert kept == {"TEST-0001-0010", None}


def test_ids_and_samples_do_not_depend_on_partitioning(spark):
    from turnscore.functions import ids

    base = spark.range(200).withColumnRenamed("id", "ex_id")
    a = {r["ex_id"]: r["s"] for r in base.select("ex_id", ids.stable_id(7, "ex_id").alias("s")).collect()}
    b = {r["ex_id"]: r["s"] for r in base.repartition(13).select("ex_id", ids.stable_id(7, "ex_id").alias("s")).collect()}
    assert a == b
    s1 = [r["ex_id"] for r in rt.sample_examples(base, 5, 42).collect()]
    s2 = [r["ex_id"] for r in rt.sample_examples(base.repartition(7), 5, 42).collect()]
    assert s1 == s2 and len(set(s1)) == 5


def test_union_keeps_duplicates_and_fills_columns(spark):
    a = spark.createDataFrame([("x", "r")], "dialogue_id string, response string")
    b = spark.createDataFrame([("x", "m")], "dialogue_id string, model string")
    u = sb.union_datasets({"a": a, "b": b}).collect()
    assert len(u) == 2 and {r["dataset"] for r in u} == {"a", "b"}
    assert {(r["model"], r["response"]) for r in u} == {(None, "r"), ("m", None)}


def test_group_without_pairs_is_kept_with_nulls(spark):
    rows = [("empty", None, 1.0), ("empty", 2.0, None), ("ok", 1.0, 2.0), ("ok", 2.0, 1.0), ("ok", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "q string, gold double, score double")
    got = {r["q"]: r for r in ag.correlations(df, ["q"]).collect()}
    assert got["empty"]["n"] == 0 and got["empty"]["pearson"] is None and got["empty"]["spearman"] is None
    assert got["ok"]["n"] == 3 and got["ok"]["spearman"] == pytest.approx(0.5)


def test_knn_does_not_depend_on_the_blocks(spark):
    rnd = random.Random(33)
    store_rows = [(i, [rnd.random() for _ in range(4)]) for i in range(30)]
    store = spark.createDataFrame(store_rows, "ex_id long, embedding array<double>")
    q = spark.createDataFrame([(100 + i, [rnd.random() for _ in range(4)]) for i in range(50)] + [(3, store_rows[3][1])],
                              "query_id long, embedding array<double>")
    one, two, five = (sorted(tuple(r) for r in rt.nearest(q, store, 4, pivots=b).collect()) for b in (1, 2, 5))
    assert one == two == five and len(one) == 51 * 4
    assert not any(r[0] == r[1] for r in one)  # query 3 excludes store row 3


def test_backup_fill_in_one_search_equals_two(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.random() for _ in range(3)], {"relevance": 2.0} if i % 4 == 0 else {"richness": 1.0}) for i in range(40)]
    store = spark.createDataFrame(rows, "ex_id long, embedding array<double>, qualities map<string, double>")
    q = store.select(F.col("ex_id").alias("query_id"), "embedding")
    two = rt.backup_fill(rt.similar_examples(q, store, 2, ("relevance",)), q, store, 2)
    one = rt.with_backup(q, store, 2, ("relevance",))
    key = lambda df: sorted((r["query_id"], r["rank"], r["ex_id"], r["source"]) for r in df.collect())
    assert key(one) == key(two) and {r[3] for r in key(one)} == {"store", "backup"}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_banned_context_paths_agree(spark):
    train = spark.createDataFrame([(i, "" if i % 3 == 0 else f"ctx{i % 7}") for i in range(60)] + [(99, None)],
                                  "dialogue_id int, context string")
    dev = spark.createDataFrame([("",), ("ctx1",), (None,)], "context string")
    small = sorted(r["dialogue_id"] for r in sb.drop_banned_contexts(train, dev).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = sorted(r["dialogue_id"] for r in sb.drop_banned_contexts(train, dev).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(i for i in range(60) if i % 3 != 0 and i % 7 != 1) + [99]
    assert small == big == want


def test_pearson_keeps_its_digits_far_from_zero(spark):
    df = spark.createDataFrame([("q", 1e8 + 0.01 * i, float(i)) for i in range(100)], "quality string, gold double, score double")
    row = ag.correlations(df, ["quality"]).first()
    assert row["pearson"] == pytest.approx(1.0, abs=1e-9) and row["spearman"] == pytest.approx(1.0, abs=1e-12)


def test_grading_counts_what_a_submission_lacks(spark):
    dims = ", ".join(f"{d} double" for d in ag.SUBTASK_DIMENSIONS["t2t"])
    gold = spark.createDataFrame([(f"u{i}", "Chatbot", "A", "YES", *[float(i)] * 4) for i in range(10)],
                                 f"UID string, SID string, CID string, SUPERVISED string, {dims}")
    sub = gold.where("UID < 'u3'").select("UID", *ag.SUBTASK_DIMENSIONS["t2t"])
    rows = ag.leaderboard(gold, sub).collect()
    assert {(r["n"], r["n_missing"]) for r in rows} == {(3, 7)}
    assert {(r["n"], r["n_missing"]) for r in ag.leaderboard_slices(gold, sub).collect()} == {(3, 7)}
    with pytest.raises(ValueError, match="lacks"):
        ag.leaderboard(gold, sub, strict=True)
    assert ag.leaderboard(gold, gold.select("UID", *ag.SUBTASK_DIMENSIONS["t2t"]), strict=True).count() == 4


def test_crowded_values_spread_over_buckets(spark):
    values = [3.0 + i * 1e-9 for i in range(200_000)]
    df = spark.createDataFrame([(v,) for v in values[::10]], "v double")
    bounds = ranks.sampled_bounds(df, ["v"], 20_000, 200)
    ranges = df.select(ranks.range_of(bounds, ["v"]).alias("m")).groupBy("m").count()
    assert ranges.agg(F.max("count")).first()[0] < 2500 and ranges.count() > 50
    for per_range in (200, ranks.PER_RANGE):
        got = [r["rank"] for r in ranks.average_rank(df, "v", per_range=per_range).orderBy("v").collect()]
        assert got == [float(i + 1) for i in range(len(got))]


def test_mining_tells_repeated_ids_apart_and_reads_dotted_names(spark):
    from turnscore.operators import mining as mn

    rows = [("d1", "m1", 1.0, 5.0), ("d1", "m2", 2.0, 1.0), ("d2", "m1", 3.0, 3.0), ("d2", "m1", 3.0, 3.0), ("d3", "m1", float("nan"), 2.0)]
    run = spark.createDataFrame(rows, ["dialogue_id", "model", "annotations.relevance", "LLM_relevance"])
    got = {(r["dialogue_id"], r["model"]): r["mean_diff"] for r in mn.rank_disagreement(run, id_col=("dialogue_id", "model")).collect()}
    assert got == {("d1", "m1"): 4.0, ("d1", "m2"): 1.0, ("d2", "m1"): 0.0, ("d3", "m1"): None}
    table = mn.ranking_table(run, id_col=("dialogue_id", "model")).first()
    assert (table["dialogue_id"], table["model"], table["scores"]["LLM_relevance"]) == ("d1", "m1", 5.0)
    bad = run.withColumnRenamed("LLM_relevance", "LLM_tone")
    with pytest.warns(UserWarning, match="annotations.relevance"):
        assert mn.column_pairs(bad.columns)[1] == ["annotations.relevance"]
        try:
            mn.rank_disagreement(bad)
        except Exception:  # no pair is left to rank
            pass


def test_nan_is_missing_and_wide_blanks_are_stripped(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.0), (3, None)], "id int, gold double")
    kept, report = gd.drop_unlabelled(df)
    assert [r["id"] for r in kept.collect()] == [2] and report.first()["n_missing"] == 2
    assert [r["v"] for r in df.select(gd.or_default("gold", 9.0).alias("v")).collect()] == [9.0, 0.0, 9.0]
    from turnscore.functions.text import trim_ws

    x = spark.createDataFrame([("\u3000\u00a0 你好 \u2003\n",)], "t string")
    assert x.select(trim_ws("t").alias("t")).first()["t"] == "你好"


def test_history_by_blocks_equals_the_window(spark):
    rows = [(d, t, f"text {d} {t}") for d in range(3) for t in range(23)] + [(1, 40, None), (2, None, "no number")]
    df = spark.createDataFrame(rows, "dialogue_id int, turn_id int, text string")
    plain = dl.dialogue_context(df.where("turn_id is not null"), block_size=None)
    for size in (1, 4, 7, 100):
        cut = dl.dialogue_context(df.where("turn_id is not null"), block_size=size)
        assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        segments = [dl.segment_context(df.where("turn_id is not null").withColumn("turn_last", F.col("turn_id").cast("string"))
                                       .withColumn("response", F.coalesce("text", F.lit(""))), block_size=b).drop("text") for b in (size, None)]
        a, b = (sorted(tuple(r[c] for c in sorted(x.columns)) for r in x.collect()) for x in segments)
        assert a == b


def test_all_prompts_differ_and_render_from_the_table(spark):
    assert len({prompts.get_prompt(n).template for n in prompts.PROMPTS}) == len(prompts.PROMPTS) == 27
    turn = spark.createDataFrame([("a {response} b", "reply")], "context string, response string")
    for row in prompts.prompt_table(spark).collect():
        p = prompts.get_prompt(row["prompt"])
        prompts.self_check(p)
        whole = turn.select(prompts.render_prompt(p).alias("t")).first()["t"]
        parts = F.array(*[F.struct(F.lit(x["lit"]).cast("string").alias("lit"), F.lit(x["col"]).cast("string").alias("col")) for x in row["parts"]])
        assert turn.select(prompts.render_parts(parts, F.col("context"), F.col("response")).alias("t")).first()["t"] == whole
