"""The cascade is exact over its universe; verdicts equal the rules read plainly."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from turnscore.llm import queries, url_filter


def asked(spark, cascade, keys):
    a, b = url_filter.key_hash(F.col("key"))
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", a.alias("a"), b.alias("b")).collect()
    h = [np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("a", "b")]
    return dict(zip([r.key for r in rows], cascade.contains(*h).tolist()))


@pytest.mark.parametrize("most_bits", [1 << 28, 2000])
def test_cascade_answers_every_key_of_the_universe(spark, most_bits):
    universe = [f"k{i}" for i in range(6000)]
    listed = [f"k{i}" for i in range(0, 6000, 11)] + ["elsewhere"]
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    cascade = url_filter.build_cascade(frame([*universe, None, "k1", "k1"]), frame([*listed, None, "k0"]), most_bits=most_bits)
    got = asked(spark, cascade, [*universe, "elsewhere"])
    assert {k for k, v in got.items() if v} == set(listed)
    assert (len(cascade.segments) > 1) == (most_bits == 2000) and max(len(s) for s in cascade.segments) > 1
    assert cascade.bits < 20 * len(listed) * len(cascade.segments)


def test_empty_list_lists_nothing(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    cascade = url_filter.build_cascade(keys, keys.where("false"))
    assert not any(asked(spark, cascade, ["a", "b"]).values())


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), h + p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


URLS = [
    None, "", "example.net/en/x", "http://", "http://example.net", "http://example.net/", "https://a.EXAMPLE.net/en/1?q=/de/#x", "x://y://net/",
    "http://net/", "http://notexample.com/de/", "http://www.example.com/de/", "http://example.com/de", "ftp://É.org/fr/é", "http://a.b.c.org/fr/#/",
    "http://.net/", "http://net./", "http://user@net:80/", "http://example.com?/de/", "http://" + "a." * 5000 + "net/" + "x" * 100_000, "http://x.org//fr/",
]


def test_verdicts_equal_the_rules(spark):
    rules = queries.BLOCK_RULES + queries.ALLOW_RULES
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    listed = spark.createDataFrame([("notexample.com",), ("example.net",)], "key string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, queries.BLOCK_RULES, queries.ALLOW_RULES, listed).collect()}
    assert len(out) == len(URLS) * 2
    block = {h + p for h, p in queries.BLOCK_RULES}
    for i, u in enumerate(URLS * 2):
        host, path, rule = plain(u, rules)
        verdict = ("block" if rule in block else "allow") if rule else ("block" if host in ("notexample.com", "example.net") else "allow")
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), u


def test_random_rules(spark):
    r = random.Random(3)
    parts, paths = ["a", "b", "c"], ["/", "/a", "/a/", "/ab/", ""]
    rules = list({(".".join(r.choices(parts, k=r.randint(1, 3))), r.choice(paths)) for _ in range(12)})
    urls = ["http://" + ".".join(r.choices(parts, k=r.randint(1, 5))) + r.choice(paths) + r.choice(["", "x", "/a"]) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.judge_urls(pages, rules[:6], rules[6:]).collect()
    for row in out:
        host, path, rule = plain(urls[row.page_id], rules)
        assert (row.host, row.path) == (host, path) and (row.rule is None) == (rule is None)
        if rule:
            assert len(row.rule) == len(rule)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, [("net", "/")], []).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({queries.ORACLE['op7_url_filters']}) order by 1").fetchall()
    got = queries.QUERIES["op7_url_filters"](spark, SMALL).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want
