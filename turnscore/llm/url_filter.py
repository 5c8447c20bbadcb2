"""URL filters by a Bloom filter cascade.

A cascade answers membership in a list exactly for every key of a known
universe, without a join: level 1 is a Bloom filter over the listed keys,
level 2 one over the universe's keys that level 1 wrongly lets pass, level 3
one over the listed keys that level 2 wrongly lets pass, and so on until a
level has no false positive left. A key's answer is the parity of the first
level that it fails. The universe is gathered from the whole corpus, so no key
of the corpus is ever answered wrongly.

Level 1 is sized so that about as many keys pass it wrongly as are listed;
all levels together take some bits per listed key however large the corpus
is. Filters travel by broadcast; a list whose filter would pass
``MOST_BITS`` is split by key hash into segments with a cascade each, so that
each broadcast stays bounded.

Cases: a url that is null or has no ``://`` has empty host and path and fits no
rule; an empty list gives a cascade that lists nothing; keys of the list that
the corpus lacks do no harm; repeated urls and ids are judged row by row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.llm.words import mix
from turnscore.session import reliable_checkpoint

#: Bits of one filter at most (32 MB); longer lists are split into segments.
MOST_BITS = 1 << 28
#: False-positive rate of the levels above the first.
RATE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_keys(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """All keys (domain suffix followed by a path prefix) under which a rule of
    the list could fit. Only suffixes with as many labels and prefixes as long
    as some rule has are formed, so a key array is bounded by the list."""
    labels = F.split(host, r"\.")
    depths = sorted({h.count(".") + 1 for h, _ in rules})
    sizes = sorted({len(p) for _, p in rules})
    keys = [
        F.when(
            (F.size(labels) >= d) & (F.length(path) >= n),
            F.concat(F.array_join(F.slice(labels, F.size(labels) - d + 1, d) if d else F.array(), "."), F.substring(path, 1, n)),
        )
        for d in depths
        for n in sizes
    ]
    keys = [F.when(F.size(labels) >= d, k) for (d, _), k in zip([(d, n) for d in depths for n in sizes], keys)]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def key_hash(key: Column) -> tuple[Column, Column]:
    """128 bits that stand for a key."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


class Level:
    """A Bloom filter: ``bits`` as 64-bit words, ``k`` positions per key."""

    def __init__(self, number: int, m: int, k: int, bits: np.ndarray):
        self.number, self.m, self.k, self.bits = number, m, k, bits

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for pos in positions(a, b, self.number, self.m, self.k):
            ok &= (self.bits[pos >> np.uint64(6)] >> (pos & np.uint64(63))) & np.uint64(1) == 1
        return ok


def positions(a: np.ndarray, b: np.ndarray, number: int, m: int, k: int):
    """The k positions of each key in the filter of a level (independent between levels)."""
    salt = np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    x, y = mix(a ^ salt), mix(b + salt) | np.uint64(1)
    for i in range(k):
        yield (x + np.uint64(i) * y) % np.uint64(m)


def _u64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _build(spark: SparkSession, keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A level over ``keys`` (columns a, b): tasks emit the filter words they
    set, equal words are or-ed by an aggregate, and the bounded result comes
    to the driver."""
    k = max(1, round(-math.log2(rate)))
    m = max(64, 64 * math.ceil(n * k / math.log(2) / 64))

    def words_set(batches):
        for batch in batches:
            a, b = _u64(batch.column(0)), _u64(batch.column(1))
            if len(a):
                pos = np.concatenate(list(positions(a, b, number, m, k)))
                yield pa.record_batch([
                    pa.array((pos >> np.uint64(6)).astype(np.int64)),
                    pa.array((np.uint64(1) << (pos & np.uint64(63))).view(np.int64)),
                ], names=["word", "mask"])

    found = keys.mapInArrow(words_set, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(m // 64, np.uint64)
    bits[found["word"].to_numpy()] = _u64(found["mask"])
    return Level(number, m, k, bits)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.passes(_u64(batch.column(0)), _u64(batch.column(1)))))

    return keys.mapInArrow(keep, "a long, b long")


class Cascade:
    """Levels by segment of the key hash; ``contains`` answers for arrays of keys."""

    def __init__(self, segments: list[list[Level]]):
        self.segments = segments

    @property
    def bits(self) -> int:
        return sum(v.m for s in self.segments for v in s)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        part = a % np.uint64(len(self.segments))
        for i, levels in enumerate(self.segments):
            alive = np.flatnonzero(part == np.uint64(i))
            for level in levels:
                ok = level.passes(a[alive], b[alive])
                out[alive[~ok]] = level.number % 2 == 0
                alive = alive[ok]
            out[alive] = len(levels) % 2 == 1
        return out


def build_cascade(universe: DataFrame, listed: DataFrame, column: str = "key", most_bits: int = MOST_BITS) -> Cascade:
    """The cascade that answers for every key of ``universe`` and of ``listed``
    whether it is listed. Null keys are ignored."""
    spark = universe.sparkSession
    a, b = key_hash(F.col(column))
    both = (
        universe.where(F.col(column).isNotNull()).select(a.alias("a"), b.alias("b"), F.lit(0).alias("listed"))
        .unionByName(listed.where(F.col(column).isNotNull()).select(a.alias("a"), b.alias("b"), F.lit(1).alias("listed")))
        .groupBy("a", "b").agg(F.max("listed").alias("listed"))
    )
    both = reliable_checkpoint(both)
    sizes = {r["listed"]: r["n"] for r in both.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_listed, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_listed:
        return Cascade([[Level(1, 64, 1, np.zeros(1, np.uint64))]])
    first = min(0.5, max(1e-9, n_listed * math.sqrt(0.5) / max(1, n_other)))
    n_segments = max(1, math.ceil(n_listed * -math.log2(first) / math.log(2) / most_bits))
    segments = []
    for s in range(n_segments):
        own = both if n_segments == 1 else both.where(_unsigned_mod("a", n_segments) == s)
        inside = own.where("listed = 1").select("a", "b")
        outside = own.where("listed = 0").select("a", "b")
        levels: list[Level] = []
        while n := inside.count():
            level = _build(spark, inside, n, len(levels) + 1, RATE if levels else first)
            levels.append(level)
            inside, outside = reliable_checkpoint(_passing(outside, level)), inside
        segments.append(levels or [Level(1, 64, 1, np.zeros(1, np.uint64))])
    return Cascade(segments)


def _unsigned_mod(column: str, n: int) -> Column:
    """The unsigned value of a long modulo n."""
    high = F.shiftrightunsigned(column, 32)
    low = F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(n)) * F.lit((1 << 32) % n) + low, F.lit(n))


def judge_urls(
    pages: DataFrame,
    block: list[tuple[str, str]],
    allow: list[tuple[str, str]],
    blocked_hosts: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` (the longest fitting rule, as host
    followed by path, or null) and ``verdict``: the rule's, else ``block`` for a
    host that ``blocked_hosts`` (column ``key``) lists, else ``allow``.

    A rule (host, path) fits its host and all subdomains if the url's path
    starts with the rule's. Rule and host membership is answered by cascades
    over all keys of the corpus; no row is joined."""
    spark = pages.sparkSession
    rules = block + allow
    parts = pages.select(
        F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    ).withColumn("keys", rule_keys(F.col("host"), F.col("path"), rules))
    universe = parts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.lit(1).alias("one"))

    def listing(some: list[tuple[str, str]]) -> DataFrame:
        return spark.createDataFrame([(h + p,) for h, p in some], "key string")

    cascades = {
        "block": build_cascade(universe, listing(block)),
        "allow": build_cascade(universe, listing(allow)),
    }
    if blocked_hosts is not None:
        hosts = parts.groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("one"))
        cascades["hosts"] = build_cascade(hosts, blocked_hosts)
    shared = spark.sparkContext.broadcast(cascades)
    asked = parts.select(
        "id", "host", "path", "keys",
        F.transform("keys", lambda k: key_hash(k)[0]).alias("a"), F.transform("keys", lambda k: key_hash(k)[1]).alias("b"),
        key_hash(F.col("host"))[0].alias("ha"), key_hash(F.col("host"))[1].alias("hb"),
    )
    id_type = pages.schema[id_column].dataType.simpleString()

    def verdicts(batches):
        c = shared.value
        for batch in batches:
            n = batch.num_rows
            keys = batch.column("keys")
            row = np.repeat(np.arange(n), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            a, b = _u64(batch.column("a").flatten()), _u64(batch.column("b").flatten())
            blocks, allows = c["block"].contains(a, b), c["allow"].contains(a, b)
            hit = np.flatnonzero(blocks | allows)
            flat = keys.flatten()
            size = np.array([len(flat[int(i)].as_py()) for i in hit], np.int64)
            order = hit[np.lexsort((size, row[hit]))]  # the longest of a row comes last
            rule, verdict = [None] * n, np.zeros(n, bool)
            if "hosts" in c:
                verdict |= c["hosts"].contains(_u64(batch.column("ha")), _u64(batch.column("hb")))
            for i in order:
                rule[row[i]] = flat[int(i)].as_py()
                verdict[row[i]] = blocks[i]
            yield pa.record_batch(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()),
                 pa.array(np.where(verdict, "block", "allow"), pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    out = asked.mapInArrow(verdicts, f"id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_column)


def tracking_hosts(pages: DataFrame, url_column: str = "url", least: int = 2) -> DataFrame:
    """Hosts (column ``key``) with ``least`` pages or more whose every url carries
    a tracking parameter (``utm_...`` or ``ref``): the list that stands in for a
    delivered block list."""
    url = F.col(url_column)
    tracked = url.rlike(r"[?&](utm_[a-z]+|ref)=").cast("int")
    return (
        pages.select(host_of(url).alias("key"), F.coalesce(tracked, F.lit(0)).alias("t"))
        .groupBy("key").agg(F.min("t").alias("all_tracked"), F.count(F.lit(1)).alias("n"))
        .where((F.col("all_tracked") == 1) & (F.col("n") >= least) & (F.col("key") != ""))
        .select("key")
    )
