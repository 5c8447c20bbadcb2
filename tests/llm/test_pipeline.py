"""The pipeline's stages on odd rows, and each stage's decisions on its input."""

import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.conftest import SMALL
from turnscore.llm import decontamination, language_id, queries
from tests.llm.test_line_templates import brute as lines_by_hand
from tests.llm.test_ngram_join import brute as components_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = C.table(spark, SMALL, "documents"), []
    for name, stage in C.STAGES:
        after = C.reliable_checkpoint(stage(spark, docs, SMALL))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encoding"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert after.where("n_chars <> length(text)").count() == 0
    assert stages[-1][2].columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_language_stage_keeps_clean_documents(stages):
    _, before, after = stages[0]
    letters = {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text)}
    kept = {r.doc_id for r in after.collect()}
    assert kept <= letters and len(kept) >= 0.99 * len(letters)


def test_language_stage_drops_what_no_language_explains(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    junk = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300)), " ".join(word() for _ in range(80)), "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(100)),
            "".join(r.choices("ABCDEFGHIJKLMabcdefghijklm0123456789+/", k=400)), "Все люди рождаются свободными и равными в своем достоинстве и правах",
            "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"]
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    planted = spark.createDataFrame([(10**6 + i, t, None, None, len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in C.keep_recognised(spark, docs.unionByName(planted), SMALL).collect()}
    assert not any(10**6 + i in kept for i in range(len(junk)))
    held = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and re.search(r"[^\W\d_]", r.text)]
    assert len(kept & set(held)) >= 0.99 * len(held)


def test_language_stage_holds_on_a_large_vocabulary(spark):
    """Training texts that would fill a small table of n-grams."""
    r = random.Random(7)
    make = lambda vowels, consonants: "".join(r.choice(consonants) + r.choice(vowels) for _ in range(r.randint(2, 5)))
    spoken = {"aa": [make("aeiou", "bcdfghlmnprst") for _ in range(30_000)], "bb": [make("aeiouyäö", "dghjklmnprstvk") + r.choice("nst") for _ in range(30_000)]}
    rows = [(i, " ".join(r.choices(spoken[x], k=300)), x, None, 0) for i, x in enumerate(["aa", "bb"] * 500)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(r.choices(letters, k=1500)), " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(300)),
            "".join(r.choices("ABCDEFGHIJKLMabcdefghijklmnopqrstuvwxyz0123456789+/", k=1500)), "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(300)),
            "Все люди рождаются свободными и равными в своем достоинстве и правах " * 5]
    docs = spark.createDataFrame(rows + [(10**6 + i, t, None, None, 0) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in C.keep_recognised(spark, docs, SMALL).collect()}
    assert not any(10**6 + i in kept for i in range(len(junk)))
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(kept & held) >= 0.97 * len(held)


def test_line_stage_drops_what_recurs(stages):
    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == sorted((r[:2] for r in lines_by_hand(rows, 10)), key=str)


def test_join_stage_keeps_one_of_each_group(stages):
    _, before, after = stages[2]
    want = {k for k, _, c in components_by_hand([(r.doc_id, r.text) for r in before.collect()], (80, 100), 5) if k == c}
    assert {r.doc_id for r in after.collect()} == want and len(want) < before.count()


def test_benchmark_stage_leaves_no_passage(stages, spark):
    _, before, after = stages[3]
    bench = C.table(spark, SMALL, "benchmark")
    check = lambda d: decontamination.decontaminate(d, bench, ["doc_id"])
    hit = {r.doc_id for r in check(before).where("contaminated").collect()}
    assert hit and check(after).where("contaminated").count() == 0
    same = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == same[r.doc_id] for r in after.collect() if r.doc_id not in hit) and after.count() == before.count()


def test_last_stage_encodes_what_is_left(stages):
    _, before, after = stages[4]
    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


ODD = [
    (1, None, None, None, None), (2, "", "en", None, 0), (3, "the same words again and again here", "en", "a", None), (4, "the same words again and again here", "en", "a", 3),
    (4, "the same words again and again here", "en", "a", 3), (None, "the same words again and again here", None, "a", 1), (5, "12 34 ###", "en", "b", 9),
    (6, "word " * 30_000, "en", "b", 9), (7, "ganz andere worte stehen hier im text", "de", None, 1),
]


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, fp string, c0 double")
    for name, stage in C.STAGES:
        before, docs = docs, C.reliable_checkpoint(stage(spark, docs, SMALL))
        if name != "bpe_encoding":
            assert docs.columns == before.columns, name
    kept = sorted((r.doc_id for r in docs.collect()), key=str)
    assert set(kept) <= {3, 6, 7, None} and 3 in kept and 4 not in kept


def test_empty_table(spark):
    docs = C.table(spark, SMALL, "documents").where("false")
    for _, stage in C.STAGES:
        docs = C.reliable_checkpoint(stage(spark, docs, SMALL))
        assert docs.count() == 0


def test_registered(spark):
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    names = set(registered())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert {"op1_chat_formatting", "op7_url_filters"} <= set(oracle_sql()) and C.ORACLE_SQL is None
    assert language_id.PER_LANGUAGE > 0
    assert C.run(spark, SMALL).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
