"""Forced-boundary encoding equals the tokenizers library."""

import hashlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tests.conftest import SMALL
from turnscore.llm import bpe, queries

ODD = [
    None, "", " \n\t", "a<|endoftext|>b c", "<|ENDOFTEXT|> Word,", "<|startoftext|>", "don't we'll !'s it's 'S 's's", "x\x01y!\x02?", "\x00",
    "ÀÉ b é ̈a İ ΑΣ ſ K", "J̌ é E\u0301,", "12 3½ ²", "日本語テスト\u3000 あ", "\u0085q \u00a0 x", "a\ufeffb", "🙂👍🏽 ok", "_foo__bar--baz", "ǅ ß Ɓa. Ⱥ",
    "word. Word, WORD; word! (word) word's. \"word\"", "".join(chr(i) for i in range(0x21, 0x300)), " ".join(f"{chr(i)}a{chr(i)}" for i in range(0x21, 0x300)),
    "long" * 20_000, "é" * 5000, "!" * 5000,
]


def reference(texts):
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_ids_and_decoded_text_equal_the_library(spark):
    texts = ODD * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(bpe.encode(docs, queries.tokenizer_path(), ["doc_id"]).collect())
    ids, decoded = reference(texts)
    for r, x, i, d in zip(got, texts, ids, decoded):
        assert (r.ids, r.decoded, r.n_tokens) == (i, d, len(i)), repr(x)[:60]


def test_cuts_are_where_no_token_joins():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        e = bpe.ForcedBoundaryBPE(f.read())
    assert "th" in e.joins and "a " not in e.joins
    for piece in ("xqzjkvwq", "the", "a", "qqqq"):
        assert e.piece_ids(piece) == e.library.encode(piece, add_special_tokens=False).ids
    assert not any(e.cut_after[letter, ord("'")] and f"{chr(letter)}'" in e.joins for letter in range(97, 123))


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids, decoded = reference(list(docs.values()))
    want = {k: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
            for k, i, d in zip(docs, ids, decoded)}
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op9_bpe_encoding"](spark, SMALL).collect()}
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, _text string, c0 int")
    out = bpe.encode(docs, queries.tokenizer_path(), ["c0", "_text", "doc_id"], output="digest")
    assert tuple(out.first())[:4] == (2, "x", 1, 2)
    assert bpe.encode(docs.where("false"), queries.tokenizer_path(), ["doc_id"]).count() == 0


def test_a_worker_keeps_no_encoder_after_its_task(spark, monkeypatch):
    caught = []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self.selectExpr("1", "2", "3", "4"))
    bpe.encode(docs, queries.tokenizer_path(), ["doc_id"])
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a word", None])], names=["c0", "_text"])
    assert [p.num_rows for p in caught[0](iter([batch]))] == [2]
    assert not bpe._ENCODERS
