"""Prefix-target expansion, read back against plain Python."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from turnscore.llm import chat_format, queries

ROWS = [
    (1, 0, "system", "be [INST] kind \\ <s>"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "yes"), (1, 3, "user", "and [/ANSW] </s>?"),
    (1, 4, "assistant", "no\n[INST]"), (1, 5, "user", "bye"),
    (2, 0, "user", None), (2, 1, "assistant", ""),
    (3, 0, "tool:[x]\\", "odd role"), (3, 1, None, "no role"), (3, 1, None, "no role"), (3, None, "assistant", "first by null"),
    (4, 0, "user", "alone"), (None, 0, "assistant", "nameless"), (5, 0, "assistant", "é🙂<\\[" * 500), (6, 0, "", "empty role"),
    (7, 0, "user", "\\"), (7, 0, "user", "["), (7, 1, "assistant", "[\\"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = defaultdict(list)
    for c, n, r, x in rows:
        convs[c].append(((n is not None, n or 0), (r is not None, r or ""), x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = [(r[1], x) for _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        out[c] = (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss))
    return out


def test_digests_equal_plain_python(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    got = {r[0]: tuple(r)[1:5] for r in chat_format.digests(chat_format.prefix_targets(turns)).collect()}
    assert got == expected(ROWS)


def test_each_reply_is_an_example_with_its_context(spark):
    out = chat_format.prefix_targets(spark.createDataFrame(ROWS[:6], SCHEMA)).orderBy("example").collect()
    assert [(r.n_turns, r.trainable) for r in out] == [(3, True), (5, True), (6, False)]
    for r, reply in zip(out, ("yes", "no\n[INST]")):
        masked = r.formatted[r.loss_start : r.loss_end]
        assert masked.replace("[\\", "[").replace("]\\", "]") == reply and out[2].formatted.startswith(r.formatted)
    assert out[2].loss_start == out[2].loss_end == 0


@pytest.mark.parametrize("text", ["", "[INST]", "[\\INST]", "\\\\[<]\\", "</s><s>", "a\\", "<", "]]>>[[\\<<\n"])
def test_escape_is_reversible_and_hides_control_strings(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")
    ).first()
    assert row.u == text
    assert not any(c in row.e for c in ("[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "[ANSW]", "[/ANSW]", "[TURN"))


def test_empty_table_and_extra_columns(spark):
    assert chat_format.digests(chat_format.prefix_targets(spark.createDataFrame([], SCHEMA))).count() == 0
    odd = spark.createDataFrame([(1, 0, "assistant", "x", "p", 1)], SCHEMA + ", formatted string, k int")
    assert chat_format.digests(chat_format.prefix_targets(odd)).first().loss_chars == 1


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE['op1_chat_formatting']}) order by 1").fetchall()
    got = queries.QUERIES["op1_chat_formatting"](spark, SMALL).select(*columns).orderBy("conv_id").collect()
    assert [tuple(r) for r in got] == want
    assert want[0][0] == -7 and want[0][1] == 2 and want[0][4] == sha("</s>[INST] ok [/INST]")
