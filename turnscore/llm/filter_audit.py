"""Filter interaction audit with radix text tries.

Which documents does a filter remove, given the filters before it? Every
document gets a mask of the filters that it fails; all orders of the filters
then follow from counts of masks.

Row filters are columns over the text. The duplicate filter fails a document
whose text is that of a document with a smaller id. For it, whole texts are
range-partitioned by adaptive prefixes, sorted, and inserted into radix tries
(compressed: an edge holds a stretch of text) whose terminals keep the smallest
id; a traversal yields, per text, the id that is no duplicate. A task inserts
its sorted texts into one trie after another of at most ``TRIE_BYTES`` (a text
is never divided between tries), so memory doesn't grow with the range. Before
texts move, each batch keeps one row per text with the smallest id there, so a
text that a third of all rows share moves once per batch.

The range bounds are prefixes of texts drawn by hash (``SAMPLE`` prefixes, a
documented bound): each is cut to the shortest prefix that tells it from the
text before it, and where many drawn texts share a prefix, longer ones are
taken. They steer where a text goes, never what is counted.

Cases: a null text is empty; an empty table has no parts; a null part value and
an empty one are one part, the empty string; rows that share an id and a text
are no duplicates of one another; a row without id is never a duplicate and
names nothing; label rows that share an id count together, those of unknown ids
not at all; very long texts pass whole; extra columns are ignored."""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W
from turnscore.session import reliable_checkpoint

#: Text that a task should get, and the ranges that it is made of, so that tasks come out alike.
TASK_BYTES, RANGES = 16 << 20, 8
MOST_RANGES = 1 << 17
#: Prefixes drawn for the bounds, and bytes of them, at most (about).
SAMPLE, SAMPLE_BYTES = 1_000_000, 16 << 20
FIRST_PREFIX = 32
TRIE_BYTES = 8 << 20

_SPACES = r"[\x20\x09-\x0D]+"


def row_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides: too short, repetitive,
    shouting, marked up."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


# ---------------------------------------------------------------- tries


class Node:
    """``label`` leads here from the parent; ``least`` is set at terminals."""

    __slots__ = ("label", "children", "least", "key")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.key = label, {}, None, None


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and of ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class TextTrie:
    """Radix trie over whole texts (bytes), keeping the smallest id of each."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, text: bytes, least, key=None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                self.size += len(text) - at + 200
                at = len(text)
            elif text.startswith(child.label, at):
                at += len(child.label)
            else:
                n = common_prefix(child.label, text, at)
                fork = Node(child.label[:n])
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                node.children[text[at]] = fork
                self.size += 200
                child, at = fork, at + n
            node = child
        if node.least is None or least < node.least:
            node.least, node.key = least, key

    def terminals(self):
        """(least id, key) of every text, in no stated order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.least is not None:
                yield node.least, node.key
            stack.extend(node.children.values())


# ---------------------------------------------------------------- ranges


def bounds(texts: DataFrame, n: int, ranges: int, sample: int = SAMPLE) -> list[bytes]:
    """Sorted prefixes that part the ``n`` texts (columns text, h) into about as many ranges."""
    if ranges < 2 or not n:
        return []
    length, share = FIRST_PREFIX, min(1.0, min(sample, 32 * ranges) / n)
    weights = _weights(texts, length, share)
    heavy = _heavy(weights, list(weights), length, ranges)
    while heavy:  # told apart by longer prefixes; the share drawn shrinks as they grow
        longer = length * 8
        less = min(share, share * SAMPLE_BYTES / (longer * sum(weights[p] for p in heavy)))
        found = _weights(texts, longer, less, heavy)
        for p in heavy:
            weights.pop(p)
        weights.update((p, w * share / less) for p, w in found.items())
        heavy, length = _heavy(weights, list(found), longer, ranges), longer
    return cut(weights, ranges)


def _heavy(weights: dict[bytes, float], among: list[bytes], length: int, ranges: int) -> list[bytes]:
    """Prefixes (not whole texts) with more than half a range's weight; at most twice as many as ranges."""
    limit = sum(weights.values()) / ranges / 2
    return [p for p in among if weights[p] > limit and weights[p] > 1 and len(p) == length]


def _weights(texts: DataFrame, length: int, share: float, of: list[bytes] | None = None) -> dict[bytes, float]:
    """How many of the texts drawn by hash begin with each prefix of ``length``
    bytes (copies count once); only texts that begin with one of the equally long ``of``."""
    rows = texts.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).select("h", F.encode("text", "utf-8").alias("b"))
    if of:
        rows = rows.where(F.substring("b", 1, len(of[0])).isin([bytearray(p) for p in of]))
    rows = rows.select("h", F.substring("b", 1, length).alias("p")).distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return {bytes(r["p"]): float(r["n"]) for r in rows.collect()}


def cut(weights: dict[bytes, float], ranges: int) -> list[bytes]:
    """Quantiles of weighted prefixes, each as short as tells it from the one before."""
    step, filled, out, before = sum(weights.values()) / ranges, 0.0, [], None
    for p in sorted(weights):
        if before is not None and filled >= step * (len(out) + 1) and len(out) < ranges - 1:
            n = common_prefix(before, p, 0) + 1
            if p[:n] > before and (not out or p[:n] > out[-1]):
                out.append(p[:n])
        filled += weights[p]
        before = p
    return out


# ---------------------------------------------------------------- duplicates


def _thinned(shared):
    """Per batch one row per text: its range, the text, its hash, the smallest id."""

    def run(batches):
        cuts = shared.value
        for batch in batches:
            t = pa.Table.from_batches([batch]).append_column("i", pa.array(np.arange(batch.num_rows)))
            best: dict[bytes, int] = {}
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            spans = t.group_by("h").aggregate([("i", "count")])
            alone = set(spans["h"].filter(pc.equal(spans["i_count"], 1)).to_pylist()) if spans.num_rows else set()
            rows, ranges = [], []
            for i, h in enumerate(batch.column("h").to_pylist()):
                if h in alone:
                    rows.append(i)
                else:
                    b = texts[i].as_buffer().to_pybytes()
                    j = best.get(b)
                    if j is None or ids[i] < ids[j]:
                        best[b] = i
            rows += best.values()
            for i in rows:
                ranges.append(bisect_right(cuts, texts[i].as_buffer().to_pybytes()))
            yield pa.record_batch(
                [pa.array(ranges, pa.int32()), *[batch.column(c).take(pa.array(rows, pa.int64())) for c in ("text", "h", "id")]], names=["range", "text", "h", "id"])

    return run


def _grow(batches):
    """Sorted texts through tries of bounded size; the smallest id per text."""
    trie, before = TextTrie(), None

    def harvest(trie):
        got = list(trie.terminals())
        return pa.record_batch([pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.int64())], names=["id", "h"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.column("id").type
        texts = batch.column("text")
        for i, (least, h) in enumerate(zip(batch.column("id").to_pylist(), batch.column("h").to_pylist())):
            text = texts[i].as_buffer().to_pybytes()
            if trie.size > TRIE_BYTES and text != before:
                yield harvest(trie)
                trie = TextTrie()
            trie.insert(text, least, h)
            before = text
    if before is not None:
        yield harvest(trie)


def originals(docs: DataFrame) -> DataFrame:
    """(id, h): per distinct text of rows (id, text) its smallest id and its hash."""
    rows = docs.where(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    spark = docs.sparkSession
    tasks = min(MOST_RANGES // RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_BYTES)))
    shared = spark.sparkContext.broadcast(bounds(rows, n, tasks * RANGES))
    kind = dict(rows.dtypes)["id"]
    thinned = rows.mapInArrow(W.lean(_thinned(shared)), f"range int, text string, h long, id {kind}")
    placed = thinned.repartition(tasks, "range").sortWithinPartitions("text")
    return placed.select("text", "h", "id").mapInArrow(W.lean(_grow), f"id {kind}, h long")


# ---------------------------------------------------------------- audit


def masks(docs: DataFrame, filters: dict[str, Column], id_column: str = "doc_id", text: str = "text", part: str = "lang", duplicates: str = "E") -> DataFrame:
    """(id, part, mask, n): rows by id, part and the filters that they fail, bit i
    for the i-th of ``filters`` (conditions over a column ``text``), the last bit for duplicates."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    # what goes on is narrow, and equal rows are one
    narrow = rows.select("id", "part", F.xxhash64("text").alias("h"), mask.alias("mask")).groupBy("id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = originals(rows.select("id", "text")).withColumn("first", F.lit(True))
    flagged = narrow.join(first, ["id", "h"], "left")
    duplicate = F.col("first").isNull() & F.col("id").isNotNull()
    return flagged.select("id", "part", (F.col("mask") + F.when(duplicate, 1 << len(filters)).otherwise(0)).alias("mask"), "n")


def label_flags(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, good, toxic) of the labelled ids."""
    return labels.where(F.col(f"`{id_column}`").isNotNull()).groupBy(F.col(f"`{id_column}`").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))


def steps(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, mask of the filters before) of all orders."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(names[i] for i in order), k + 1, 1 << f, before))
            before |= 1 << f
    return out


def interactions(counts: DataFrame, names: list[str]) -> DataFrame:
    """The audit of mask counts (part, mask, good, toxic, n; one row per
    combination at most, so a bounded table per part)."""
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("bit"), F.lit(b).alias("before")) for o, k, f, b in steps(names)])
    rows = counts.select("part", "mask", "good", "toxic", "n", F.inline(table))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    only = F.col("mask") == F.col("bit")
    # among the orders, each of a mask's filters stands first equally often
    turns = F.when(fails, F.lit(factorial(len(names))) / F.greatest(F.bit_count("mask"), F.lit(1))).otherwise(0).cast("long")

    def total(condition, of=None):
        return F.sum(F.when(condition, F.col("n") if of is None else F.col("n") * of).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(only).alias("unique_fails"),
        total(fails & ~earlier & F.col("good")).alias("good_lost"), total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"), F.sum(F.col("n") * turns).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_column: str = "doc_id", text: str = "text", part: str = "lang", duplicates: str = "E") -> DataFrame:
    """Per part, order of all filters and step: what the step's filter keeps,
    removes, fails again, alone fails, loses of good and of toxic documents, and its Shapley sum."""
    filters = filters or row_filters(F.col("text"))
    found = masks(docs, filters, id_column, text, part, duplicates)
    flagged = found.join(label_flags(labels, id_column), "id", "left")
    counts = flagged.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    return interactions(reliable_checkpoint(counts), [*filters, duplicates])
