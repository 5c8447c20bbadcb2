"""Source / sink round trips and plan checks."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import types as T

from tests.conftest import SMALL
from turnscore.plans import checks
from turnscore.schemas import dialogue_schema
from turnscore.sources import io


def test_csv_round_trip_edge_cases(spark):
    rows = [("a", 'quote " inside'), ("b", "new\nline"), ("c", "trailing\\"), ("d", ""), ("e", None)]
    schema = T.StructType([T.StructField("UID", T.StringType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    path = tempfile.mkdtemp(prefix="ts-csv-") + "/out"
    io.write_csv(df, path)
    back = sorted((r["UID"], r["text"]) for r in io.read_csv(spark, path, schema).collect())
    assert back == sorted(rows)


def test_read_multiline_json_array(spark):
    recs = [{"dialogue_id": "x1", "model": "m", "context": "a\nb", "response": "r",
             "annotations": {"relevance": [1.0, 2.0]}},
            {"dialogue_id": "x2", "model": "m", "context": "", "response": "",
             "annotations": {"relevance": []}}]
    d = tempfile.mkdtemp(prefix="ts-json-")
    with open(os.path.join(d, "ds.json"), "w") as f:
        json.dump(recs, f, indent=2)
    df = io.read_dialogue_json(spark, d, dialogue_schema(["relevance"]))
    flat = {r["dialogue_id"]: r["ratings"] for r in io.flatten_annotations(df).collect()}
    assert flat == {"x1": [1.0, 2.0], "x2": []}


def test_nested_json_round_trip(spark):
    df = spark.createDataFrame([("x", 1.5, 2.0)], "dialogue_id string, content double, relevance double")
    path = tempfile.mkdtemp(prefix="ts-nj-") + "/out"
    io.write_nested_json(df, path, ["content", "relevance"])
    schema = T.StructType([T.StructField("dialogue_id", T.StringType()),
                           T.StructField("annotations", T.StructType(
                               [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("content", "relevance")]))])
    r = io.read_dialogue_json(spark, path, schema, multiline=False).first()
    assert r["annotations"]["content"] == [1.5] and r["annotations"]["relevance"] == [2.0]


def test_results_partition_pruning(spark):
    root = tempfile.mkdtemp(prefix="ts-res-") + "/results"
    df = spark.createDataFrame([("u", 1.0)], "uid string, score double")
    io.write_results(df, root, "r1")
    io.write_results(df, root, "r2")
    q = io.read_results(spark, root, "r2")
    assert "PartitionFilters: [isnotnull(run_id" in q._jdf.queryExecution().executedPlan().toString()
    assert q.count() == 1


def test_plans_have_no_cartesian_or_single_partition(spark):
    from __spark_entry__ import queries

    qs = queries()
    for name in ("A4_spearman", "A7_leaderboard", "W1_dialogue_context", "F5_default_and_flag",
                 "A2_composite_quality", "J7_gold_pred_cross", "J1_gold_lookup", "A14_token_pooling",
                 "E3_grade_submission", "A10_pooled_evaluation", "J6_ensemble_features"):
        problems = checks.plan_problems(qs[name](spark, SMALL))
        assert problems == [], (name, problems)


def test_scoring_is_the_only_python_node(spark):
    from __spark_entry__ import queries

    df = queries()["M1_batch_score"](spark, SMALL)
    assert checks.python_nodes(df) == 1
    assert checks.python_nodes(queries()["F5_default_and_flag"](spark, SMALL)) == 0


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert {r["quality"] for r in rows} <= {"appropriateness", "richness", "grammatical", "relevance"}
    assert len(rows) == 4


def test_e1_scoring_plan_has_one_python_node_and_no_cartesian(spark):
    from turnscore.functions import prompts, replies
    from turnscore.operators import scoring
    from turnscore.plans.q_text import kept_pairs

    p = prompts.get_prompt("op-all-02")
    pairs = kept_pairs(spark, SMALL).withColumn("prompt", prompts.render_prompt(p))
    raw = scoring.batch_score(pairs, keep=("uid", "context", "response", "prompt"))
    parsed = replies.parse_replies(raw, p.qualities, "reply", keep=("uid", "call_failed"))
    assert checks.python_nodes(parsed) == 1
    assert checks.plan_problems(parsed) == []


def test_mining_job_has_no_cartesian(spark):
    from __spark_entry__ import queries

    plan = checks.physical_plan(queries()["E4_mine_hard_set"](spark, SMALL))
    assert not any(op in plan for op in checks.FORBIDDEN)


def test_sinks_are_idempotent_per_partition(spark):
    root = tempfile.mkdtemp(prefix="ts-idem-") + "/results"
    df = spark.createDataFrame([("u", 1.0), ("v", 2.0)], "uid string, score double")
    io.write_results(df, root, "r1")
    io.write_results(df, root, "r1")  # a retried job
    io.write_results(df.limit(1), root, "r2")
    counts = {r["run_id"]: r["count"] for r in io.read_all_runs(spark, root).groupBy("run_id").count().collect()}
    assert counts == {"r1": 2, "r2": 1}
    runs = tempfile.mkdtemp(prefix="ts-runs-") + "/runs"
    io.append_run(spark, runs, "a", "op-all-02", "m", 1)
    io.append_run(spark, runs, "a", "op-all-02", "m", 2)
    io.append_run(spark, runs, "b", "vh-relevance-01", "m", 3)
    got = {r["run_id"]: r["seed"] for r in io.read_runs(spark, runs).collect()}
    assert got == {"a": 2, "b": 3}


def test_session_helpers(spark):
    from turnscore import session

    d = session.checkpoint_dir(spark)
    assert d == spark.sparkContext.getCheckpointDir()  # the session's folder, not a new one
    path = session.scratch_path(spark, "x")
    assert path.startswith(session.scratch_root(spark) + "/x-") and path.startswith(d.rstrip("/") + "/turnscore/")
    conf = session.cluster_conf(100 * 10**12, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) >= 16000
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = session.cluster_conf(10**6, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_rehearsal_rows_come_back_by_name_with_the_defaults(spark, tmp_path):
    from turnscore.plans import datasets
    from turnscore.sources import catalogue

    name = "rehearsal-copy-hard"
    rule, annotations = catalogue.lookup(name)
    cols = ["dialogue_id", "model", "context", "response", *annotations]
    rows = spark.createDataFrame([(f"d{i}", "m", "c", "r", *[float(1 + i % 5)] * len(annotations)) for i in range(10)], cols)
    io.write_nested_json(rows, catalogue.dataset_path(name, str(tmp_path)), list(annotations))
    pairs, gold = datasets.load_dialogue_dataset(spark, str(tmp_path), name)
    assert pairs.count() == 10 and gold.select("dialogue_id").distinct().count() == 10


def test_json_layout_is_told_from_the_files(spark, tmp_path):
    import pytest

    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("l", T.ArrayType(T.DoubleType()))])
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text('{"a": 1.0}\n{"a": 2.0, "l": [1.0]}\n')
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "x.json").write_text('[\n {"a": 1.0},\n {"a": 2.0}\n]\n')
    (tmp_path / "mixed").mkdir()
    for k in ("lines", "array"):
        assert io.json_layout(spark, str(tmp_path / k)) == k
        assert io.read_dialogue_json(spark, str(tmp_path / k), schema).count() == 2
        (tmp_path / "mixed" / f"{k}.json").write_text((tmp_path / k / "x.json").read_text())
    with pytest.raises(ValueError, match="multiline"):
        io.read_dialogue_json(spark, str(tmp_path / "lines"), schema, multiline=True)
    with pytest.raises(ValueError, match="mixes"):
        io.json_layout(spark, str(tmp_path / "mixed"))


def test_run_ids_stay_as_given(spark, tmp_path):
    root = str(tmp_path / "runs")
    for run in ("007", "7"):
        io.write_results(spark.createDataFrame([(run, 1.0)], "uid string, score double"), root, run)
    back = io.read_results(spark, root, "007")
    assert [(r["run_id"], r["uid"]) for r in back.collect()] == [("007", "007")]
    io.append_run(spark, str(tmp_path / "m"), "01", "p", "m", 1)
    assert io.read_runs(spark, str(tmp_path / "m")).first()["run_id"] == "01"


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from turnscore.session import checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))


def test_a_reader_sees_one_published_version(spark, tmp_path):
    root = str(tmp_path / "results")
    rows = lambda v, n: spark.createDataFrame([(f"u{i}", v) for i in range(n)], "uid string, score double")
    io.write_results(rows(1.0, 3), root, "r/1 x")
    early = io.read_results(spark, root, "r/1 x")
    # a re-run that dies after writing files leaves nothing to see
    real = io._put_text
    io._put_text = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        io.write_results(rows(2.0, 5), root, "r/1 x")
    except RuntimeError:
        pass
    finally:
        io._put_text = real
    assert {r["score"] for r in io.read_results(spark, root, "r/1 x").collect()} == {1.0}
    io.write_results(rows(3.0, 4), root, "r/1 x")
    assert [r["score"] for r in early.collect()] == [1.0] * 3  # who had resolved the run still reads the whole old one
    assert [r["score"] for r in io.read_results(spark, root, "r/1 x").collect()] == [3.0] * 4
    stream = str(tmp_path / "stream")
    for run, epoch, v in (("s", 1, 4.0), ("s", 2, 5.0), ("s", 1, 6.0), ("t", 1, 7.0)):
        io.write_results(rows(v, 1), stream, run, {"epoch": epoch})
    assert sorted(r["score"] for r in io.read_results(spark, stream, "s").collect()) == [5.0, 6.0]
    assert sorted(r["score"] for r in io.read_all_runs(spark, stream).collect()) == [5.0, 6.0, 7.0]


def test_old_versions_go_but_the_last_one(spark, tmp_path):
    root = str(tmp_path / "results")
    for i in range(4):
        io.write_results(spark.createDataFrame([("u", float(i))], "uid string, score double"), root, "r1")
    left = [d for d in os.listdir(f"{root}/run_id=r1") if d.startswith("version=")]
    assert len(left) == 2 and io.read_results(spark, root, "r1").first()["score"] == 3.0


def test_layout_needs_the_heads_of_the_files_only(spark, tmp_path):
    import gzip

    long = json.dumps({"context": "x" * 300_000})
    files = {"lines.json": f"\n\n{long}\n{{}}\n", "one.json": long, "array.json": "[" + long + "]", "spread.json": "{\n" + long[1:], "blank.json": " \n" * 50_000, "bom.json": "\ufeff{}\n"}
    want = {"lines.json": "lines", "one.json": "lines", "array.json": "array", "spread.json": "array", "blank.json": "lines", "bom.json": "lines"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        assert io.json_layout(spark, str(tmp_path / name)) == want[name], name
    with gzip.open(tmp_path / "packed.json.gz", "wt") as f:
        f.write(files["lines.json"])
    assert io.json_layout(spark, str(tmp_path / "packed.json.gz")) == "lines"
