"""Template counts against plain Python."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from turnscore.llm import exchange, words
from turnscore.llm import line_templates as T


def brute(rows, least):
    texts = sorted({t or "" for _, t in rows})

    def fields(line):
        return ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]

    lines = {t: [fields(x) for x in t.split("\n")] for t in texts}
    leaf, place, template, of = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for t in texts:
        for f in filter(None, lines[t]):
            leaf[len(f), tuple(f[: T.DEPTH])].add(t)
    often = lambda f: f and len(leaf[len(f), tuple(f[: T.DEPTH])]) >= least
    for t in texts:
        for f in filter(often, lines[t]):
            for i, x in enumerate(f):
                place[len(f), tuple(f[: T.DEPTH]), i, x].add(t)
    for t in texts:
        for n, f in enumerate(lines[t]):
            if often(f):
                fixed = [x != "<*>" and len(place[len(f), tuple(f[: T.DEPTH]), i, x]) >= least for i, x in enumerate(f)]
                if sum(fixed) * 10 >= 7 * len(f):
                    k = (tuple(f[: T.DEPTH]), tuple(x if c else "<*>" for x, c in zip(f, fixed)))
                    template[k].add(t)
                    of[t, n] = k
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        gone = [(t or "", n) in of and len(template[of[t or "", n]]) >= least for n in range(len(all_))]
        out.append((i, None if t is None else "\n".join(x for x, g in zip(all_, gone) if not g), len(all_) if t else 0, sum(gone)))
    return sorted(out, key=str)


def made_up(seed):
    r = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnopq"] + ["É"]
    rows = []
    for i in range(60):
        lines = [" ".join(r.choices(words, k=r.randint(0, 6))) for _ in range(r.randint(1, 5))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), f"page {r.randint(1, 99)} of the {r.choice(words)} report , copy")
        if r.random() < 0.3:
            lines += ["all rights reserved"] * r.randint(1, 3)
        rows.append((i, "\n".join(lines)))
    return rows + [(60, None), (61, ""), (62, "\n\n"), (63, "7"), (63, "7"), (None, "all rights reserved\n"), (64, rows[3][1]), (65, rows[3][1])]


def run(spark, rows, least):
    out = T.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=str)


@pytest.mark.parametrize("seed, least", [(1, 4), (2, 8)])
def test_dropped_lines_equal_plain_counts(spark, monkeypatch, seed, least):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 1 << 10)
    monkeypatch.setattr(exchange, "BUCKET_ENTRIES", 1 << 6)
    rows = made_up(seed)
    want = brute(rows, least)
    assert run(spark, rows, least) == want and any(r[3] for r in want)


def test_variable_fields_are_one_template_and_copies_are_not_recurrence(spark):
    lines = [(i, f"only {'abcdefghijklmnopqrst'[i] * 4} here\nseen on page {i}") for i in range(12)]
    got = run(spark, lines + [(100 + i, "never seen before\nreally") for i in range(30)], 10)
    assert all(r[3] == 1 and "page" not in r[1] for r in got if r[0] < 100)
    assert all(r[3] == 0 for r in got if r[0] >= 100)


@pytest.mark.parametrize("shard_bytes", [1 << 10, 1 << 22])
def test_near_copies_are_not_recurrence(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(exchange, "SHARD_BYTES", shard_bytes)
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    body = [[word() for _ in range(10)] for _ in range(30)]
    ten, nine = "printed by the press of the town", "sold at the gate of the mill"
    rows = []
    for i in range(20):  # one word of each copy altered
        lines = [list(x) for x in body]
        lines[i][5] = word()
        extra = [ten] * (i != 0) + [nine] * (i % 2)
        rows.append((i, "\n".join([" ".join(x) for x in lines] + extra)))
    for i in range(9):
        rows.append((100 + i, "\n".join([" ".join(word() for _ in range(10)), ten] + [nine] * (i < 8))))
    got = dict((x[0], x[1]) for x in run(spark, rows, 10))
    assert got == {i: "\n".join(x for x in t.split("\n") if x != ten) for i, t in rows}


@pytest.mark.parametrize("least, dropped", [(250, 400), (300, 400), (400, 400), (401, 0)])
def test_counts_have_no_cap(spark, least, dropped):
    r = random.Random(8)
    rows = [(i, "all rights reserved here\n" + " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(8))) for i in range(400)]
    assert sum(x[3] for x in run(spark, rows, least)) == dropped


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [], 2) == []
    docs = spark.createDataFrame([("x", 1, "a\nb", 2, "p")], "h1 string, n_lines int, text string, dropped int, _row string")
    out = T.drop_recurring_lines(docs).first()
    assert (out.h1, out.text, out.n_lines, out.dropped, out._row, out.n_dropped) == ("x", "a\nb", 2, 2, "p", 0)


def test_templates_are_sums_of_fixed_size(spark, monkeypatch):
    """Written tables are aggregated without lists, so rows of a line merge before they are shuffled."""
    plans, write = [], T.reliable_checkpoint
    monkeypatch.setattr(T, "reliable_checkpoint", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    rows = made_up(3)
    assert run(spark, rows, 5) == brute(rows, 5)
    assert plans and not any("collect_list" in p for p in plans)


def test_hashes_are_summed_in_short_stretches(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", {})
    texts = [" ".join(f"w{i * j % 997}" for j in range(250)) for i in range(600)]
    w = words.split(pa.array(texts))
    assert max(p.nbytes for both in words._POWERS.values() for p in both) <= 1 << 19
    monkeypatch.setattr(words, "STRETCH", 1 << 20)
    assert (words.split(pa.array(texts)).hashes[0] == w.hashes[0]).all()
