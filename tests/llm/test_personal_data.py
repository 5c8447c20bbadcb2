"""Base patterns against plain regular expressions; disguises planted in clean text."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from tests.conftest import SMALL
from turnscore.llm import personal_data as P
from turnscore.llm import queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(bare(m)) <= 19 and luhn(bare(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(bare(m)) <= 15]
    return sorted(out)


def only(text, kind=None):
    """What the spans of one text cover."""
    return [text[a:b] for k, a, b in P.scan(pa.array([text]))[1][0] if kind is None or P.KINDS[k] == kind]


@pytest.mark.parametrize("alphabet", ["a1@.-", "0123.", "0123456789 -", "+12 ().-", "a@.+1 é2-\n", "+0123456789 "])
def test_base_spans_equal_plain_patterns(alphabet):
    r = random.Random(alphabet)
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 45))) for _ in range(5000)] + [None, ""]
    assert P.scan(pa.array(texts))[0] == [plain(t) for t in texts]


def test_long_texts_take_linear_time():
    for text in ("a" * 500_000, "a." * 300_000 + "@", "1" * 500_000, "1." * 300_000, "+1" * 200_000, "@" * 300_000, "one " * 100_000, "(at" * 100_000):
        assert P.scan(pa.array([text]))[0] == [[(1, a * 8, a * 8 + 7) for a in range(75_000)] if text.startswith("1.") else []]


DISGUISED = [
    ("write to john.doe [at] example [dot] com today", "email", "john.doe [at] example [dot] com"),
    ("john(at)mail.example.com", "email", "john(at)mail.example.com"),
    ("john { ät } beispiel {punkt} de", "email", "john { ät } beispiel {punkt} de"),
    ("ask john at example dot com for it", "email", "john at example dot com"),
    ("ask john at mail.example dot co dot uk, or", "email", "john at mail.example dot co dot uk"),
    ("joe@mail dot com", "email", "joe@mail dot com"),
    ("mail jоhn@exаmple.com here", "email", "jоhn@exаmple.com"),  # Cyrillic letters
    ("ｊｏｅ＠ｍａｉｌ．ｃｏｍ", "email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ"),
    ("joe​@ma­il.com", "email", "joe​@ma­il.com"),
    ("call plus four nine one five one two three four five six seven eight now", "phone", "plus four nine one five one two three four five six seven eight"),
    ("call plus 49 151 2345 6789", "phone", "plus 49 151 2345 6789"),
    ("+49 151‑2345 6789", "phone", "+49 151‑2345 6789"),
    ("card four one one one 1111 1111 1111.", "card", "four one one one 1111 1111 1111"),
    ("4111 1111 1111 111l1 no, 41l1 1111 11I1 1111", "card", "41l1 1111 11I1 1111"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("host 1９2.168.0.１ is up", "ip", "1９2.168.0.１"),
    ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
    ("SECHS null null drei NULL vier 1234567 eins", "card", None),
]


@pytest.mark.parametrize("text, kind, want", DISGUISED)
def test_disguises_are_found_where_they_stand(text, kind, want):
    assert only(text, kind) == ([want] if want else [])
    assert P.scan(pa.array([text]))[0][0] == plain(text)


@pytest.mark.parametrize("text", [
    "look at the dot product", "we met at example.com headquarters", "at some point in time", "one two three, four", "a (at) b", "the point at issue dot the i",
    "twenty one plus two makes 23", "Привет, как дела? Ελληνικά", "1O1 l0l O0O", "un deux trois quatre cinq", "dot com", "see [dot] and (at)",
])
def test_clean_texts_are_left_alone(text):
    assert P.scan(pa.array([text])) == ([[]], [[]])


def test_base_spans_stay_and_are_not_doubled():
    text = "call +1 555 123 4567 one time, j.doe@mail.exаmple.com"
    base, spans = (x[0] for x in P.scan(pa.array([text])))
    assert base == plain(text) and set(base) <= set(spans)
    assert [text[a:b] for k, a, b in spans if k == 3] == ["+1 555 123 4567"]
    assert "j.doe@mail.exаmple.com" in [text[a:b] for _, a, b in spans]


def test_traces_miss_no_disguise():
    """The transducers on every text find nothing beyond those on texts with a trace."""
    r = random.Random(3)
    pieces = ["one", "FÜNF", "zéro", "plus", "at", "dot", "[at]", "( DOT )", "joe", "mail", "com", "5", "192", "+", "@", ".", " ", " ", " ", "-", "О", "０", "​", "l", "é"]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 30))) for _ in range(3000)]
    data, offsets = P.W.utf8(pa.array(texts))
    traced = set(P.traces(data, offsets).tolist())
    for i, text in enumerate(texts):
        if i not in traced:
            tape = P.deobfuscate(text)
            assert tape.text == text or plain(tape.text) == [] == plain(text) or len(plain(tape.text)) <= len(plain(text)), text


def test_transducers_map_back_each_character():
    tape = P.deobfuscate("x​ [at] ｙ dot com +five one")
    assert tape.text == "x@y.com +51"
    assert [(int(a), int(b)) for a, b in zip(tape.low, tape.high)][:4] == [(0, 1), (2, 8), (8, 9), (9, 14)]


def test_redaction(spark):
    docs = spark.createDataFrame([("a joe@x.de, +1 555 123 4567 é 10.0.0.1",), (None,), ("",), ("joe [at] x [dot] de",)], "text string")
    out = P.find_personal(docs, ["text"]).select("text", P.redact(P.F.col("text"), P.F.col("found")).alias("clean"))
    assert {r.text: r.clean for r in out.collect()} == {"a joe@x.de, +1 555 123 4567 é 10.0.0.1": "a <email>, <phone> é <ip>", None: None, "": "", "joe [at] x [dot] de": "<email>"}


def test_empty_table_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, "x", "y"), (1, "a@b.c", "x", "y"), (1, "a@b.c", "x", "y")], "doc_id long, text string, found string, c0 string")
    out = P.find_personal(docs, ["doc_id", "c0"]).collect()
    assert sorted((r.c0, len(r.base), len(r.found)) for r in out) == [("y", 0, 0), ("y", 1, 1), ("y", 1, 1)]
    assert P.find_personal(docs.where("false"), ["doc_id"]).count() == 0


def test_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op13_personal_data"](spark, SMALL).collect()
    assert len(got) == len(docs) and any(r.n_email for r in got)
    for r in got:
        want = plain(docs[r.doc_id])
        listed = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
