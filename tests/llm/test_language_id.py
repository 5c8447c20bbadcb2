"""Held-out accuracy and edge cases of the string-kernel classifier."""

import zlib

import numpy as np
import pyarrow as pa

from turnscore.llm import language_id as L
from turnscore.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op4_language_id"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in {"de", "en", "es", "fr", "und"}
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def model():
    return L.solve(["the cat and the dog", "this is the thing"] * 3 + ["der hund und die katze", "das ist nicht gut"] * 3, ["en"] * 6 + ["de"] * 6)


def test_prediction_sees_the_text_alone(spark):
    m = model()
    docs = spark.createDataFrame([(1, "the dog", "de", "x"), (1, "the dog", None, "y"), (2, "die katze", "en", None), (None, "die katze", "en", "z")],
                                 "doc_id long, text string, lang string, _text string")
    out = sorted(map(tuple, L.classify(docs, m, ["doc_id", "_text"]).collect()), key=str)
    assert sorted(r[2] for r in out) == ["de", "de", "en", "en"]
    assert out[0][3] == out[1][3] and all(r[1] in ("x", "y", "z", None) for r in out)


def test_texts_without_letters_are_undetermined():
    lang, score = model().predict(pa.array([None, "", " \n", "12 ### €", "the 1", "日本", "́", "a" * 300_000], pa.string()))
    assert [x == L.UNDETERMINED for x in lang] == [True] * 4 + [False, False, True, False]
    assert all(s == 0 for s, x in zip(score, lang) if x == L.UNDETERMINED) and ((score >= 0) & (score <= 1)).all()


def test_presence_counts_each_gram_once():
    p = L.Presence()
    for text in (b"", b"a", b"abcabcabc  abc", "éa éa".encode()):
        data = np.frombuffer(text, np.uint8)
        g = p.of(data)
        assert len(g) == len(set(g.tolist())) and set(g.tolist()) == set(L.grams(data).tolist())
    assert set(L.grams(np.frombuffer(b"AB  c", np.uint8))) == set(L.grams(np.frombuffer(b"ab,c", np.uint8)))


def test_without_training_rows_everything_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(docs, ["doc_id"]).orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert L.identify(docs.where("false"), ["doc_id"]).count() == 0


def test_hot_text_and_ties(spark):
    docs = spark.createDataFrame([(i, "same text here", "en") for i in range(50)] + [(100 + i, "andere worte dort", "de") for i in range(50)],
                                 "doc_id long, text string, lang string")
    out = L.identify(docs, ["doc_id"], per_language=5).collect()
    assert {(r.doc_id >= 100, r.lang_pred) for r in out} <= {(False, "en"), (True, "de"), (False, "und"), (True, "und")}
