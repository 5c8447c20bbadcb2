"""N-gram Jaccard join by a size-aware heavy-light scheme.

A document's set holds its distinct word shingles. Equal sets are one class, so
copies are never paired. Between different sets:

* light: sets up to a boundary size enumerate fixed-size subsets. For sizes
  (a, b) two sets reach the threshold exactly if they share a subset of
  ``least_overlap(a, b)`` shingles, so sharing one is a link, and all holders of
  a subset link to the smallest of them.
* heavy: larger sets scan inverted lists, those of their rarest shingles only:
  with shingles ordered by corpus frequency, two sets that reach the threshold
  share one among the first ``s - ceil(t s) + 1``. Frequencies are counted over
  the whole corpus (see ``exchange``). A set of which more than ``1 - t`` is
  found nowhere else has no partner and drops out at once. In each list all
  members first meet one hub (the member most made of common shingles); then only
  members that do not link with it meet the others, so a group of near copies
  costs about its size and not its square. Candidates pass a lossless filter (parity
  sketches bound the symmetric difference from below), then the exact overlap
  is counted.

The boundary minimises the cost of both sides over the corpus's sizes.

Cases: documents without words (null, empty or blank texts) have an empty set
and link with nothing; fewer words than a shingle make one shingle of the whole
sequence; a null id never becomes a component's name unless all its ids are
null; repeated rows are copies; ties on ids fall together; extra columns are
ignored."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import exchange as X
from turnscore.llm import words as W
from turnscore.llm.components import connected_components
from turnscore.session import reliable_checkpoint

SHINGLE = 3
#: The threshold as a fraction.
THRESHOLD = (90, 100)
#: Sets up to this size may be light.
MOST_LIGHT = 40
#: Cost of a shingle of a heavy set (counted, sorted, listed) in subsets of a light one.
SCAN_COST = 4
SKETCH_WORDS = 8
#: Bytes of text whose sets are built at once; a worker holds about twenty times as much meanwhile.
CHUNK = 1 << 20
#: Bytes of distinct text of a shard: half of what others take, since its sets and their messages are held together.
SHARD_BYTES = X.SHARD_BYTES // 2


def least_overlap(a: int, b: int, t: tuple[int, int] = THRESHOLD) -> int:
    """Smallest intersection with which sets of a and b shingles link."""
    return -(-t[0] * (a + b) // (t[0] + t[1]))


class Sets:
    """Shingle sets of a batch of texts: ``elements[bounds[r]:bounds[r+1]]``,
    sorted; ``fp`` two fingerprints per set. ``words``: the lower-cased words,
    where they are known already."""

    def __init__(self, texts, shingle: int, words: W.Words | None = None):
        w = W.split(texts, lower=True) if words is None else words
        hashes, bounds = w.hashes[0], w.bounds
        del w  # a worker's memory counts: nothing is held longer than it is needed
        n = np.diff(bounds)
        size = np.clip(n, 1, shingle)  # shingle length of each row
        count = np.where(n > 0, np.maximum(n - size + 1, 0), 0)
        row = np.repeat(np.arange(len(n)), count)
        start = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + bounds[row]
        h = np.zeros(len(row), np.uint64)
        for k in range(1, shingle + 1):
            of = size[row] == k
            if of.any():
                h[of] = W.mix(W.window_hash(hashes, start[of], k, W.WINDOW_BASES[0]) + W.U64(k))
        del hashes, start
        row = row.astype(np.uint16 if len(n) < 1 << 16 else np.int64)
        order = np.argsort(h)
        h, row = h[order], row[order]
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
        del order
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
        self.elements, row = h[new], row[new]
        del h, new
        self.sizes = np.bincount(row, minlength=len(n)).astype(np.int64)
        self.bounds = np.r_[0, np.cumsum(self.sizes)]
        self.fp = [W.mix(self.sums(W.mix(self.elements ^ c)) + self.sizes.astype(np.uint64)) for c in W.BASES]

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.r_[W.U64(0), np.cumsum(values)]
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def keys(self) -> list[bytes]:
        flat = np.stack(self.fp, axis=1).tobytes()
        return [flat[i : i + 16] for i in range(0, len(flat), 16)]


def set_table(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns (as c0, c1, ...), ``n_shingles``, ``fp`` (names the set) and,
    for small sets, ``elements``."""
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, rows.schema)] + ["n_shingles long", "fp binary", "elements binary"])

    def run(batches):
        for batch in batches:
            for part in W.chunks(batch, "_text", CHUNK):
                s = Sets(part.column("_text"), shingle)
                small = [
                    s.elements[a:b].tobytes() if 0 < b - a <= MOST_LIGHT else None
                    for a, b in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist())
                ]
                yield pa.record_batch(
                    [*[part.column(k) for k in kept], pa.array(s.sizes, pa.int64()), pa.array(s.keys(), pa.binary()), pa.array(small, pa.binary())],
                    names=[*kept, "n_shingles", "fp", "elements"],
                )

    return rows.mapInArrow(W.lean(run), schema)


def light_pairs(size: int, boundary: int, t: tuple[int, int] = THRESHOLD):
    """(a, b, shingles left out, side) of all subsets that a light set of a size enumerates."""
    for b in range(size, min(boundary, size * t[1] // t[0]) + 1):
        o = least_overlap(size, b, t)
        if o <= size:
            yield size, b, size - o, 0
    for a in range(-(-t[0] * size // t[1]), size):
        o = least_overlap(a, size, t)
        if o <= a:
            yield a, size, size - o, 1


def n_subsets(size: int, boundary: int, t: tuple[int, int] = THRESHOLD) -> int:
    from math import comb

    return sum(comb(size, k) for _, _, k, _ in light_pairs(size, boundary, t))


def choose_boundary(histogram: dict[int, int], t: tuple[int, int] = THRESHOLD) -> int:
    """The light sets' largest size, by the cost over all sets: subsets of the
    light ones, scans of those that the heavy ones may link with."""

    def cost(x: int) -> int:
        light = sum(n * n_subsets(s, x, t) for s, n in histogram.items() if s <= x)
        return light + sum(n * s * SCAN_COST for s, n in histogram.items() if s >= first_heavy(x, t))

    return min(range(MOST_LIGHT + 1), key=cost)


def first_heavy(boundary: int, t: tuple[int, int] = THRESHOLD) -> int:
    """Smallest size that may link with a set above the boundary."""
    return -(-t[0] * (boundary + 1) // t[1])


def light_links(sets: DataFrame, boundary: int, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Links (a, b) of light sets (columns fp, n_shingles, elements): holders of
    a subset and the smallest holder."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("n_shingles").to_numpy()
            for s in np.unique(sizes):
                at = np.flatnonzero(sizes == s)
                own = batch.take(pa.array(at))
                e = np.frombuffer(b"".join(own.column("elements").to_pylist()), np.uint64).reshape(-1, int(s))
                for a, b, k, side in light_pairs(int(s), boundary, t):
                    chosen = list(combinations(range(int(s)), k))
                    drop = np.array(chosen, np.int64).reshape(len(chosen), k)
                    keys = []
                    for base in W.BASES:
                        m = W.mix(e ^ base)
                        left = m.sum(axis=1, dtype=np.uint64)[:, None] - m[:, drop].sum(axis=2, dtype=np.uint64)
                        keys.append(pa.array(W.mix(left + W.U64(a * 1000 + b)).ravel().view(np.int64)))
                    fp = own.column("fp").take(pa.array(np.repeat(np.arange(len(at)), len(drop))))
                    n = len(fp)
                    yield pa.record_batch(
                        [*keys, pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, a == b)), fp], names=["k1", "k2", "side", "same", "fp"]
                    )

    subsets = sets.where(F.col("n_shingles").between(1, boundary)).select("fp", "n_shingles", "elements").dropDuplicates(["fp"])
    subsets = subsets.mapInArrow(W.lean(run), "k1 long, k2 long, side int, same boolean, fp binary")
    hubs = subsets.groupBy("k1", "k2").agg(
        F.min("fp").alias("hub"), F.max("fp").alias("other"), F.min("side").alias("s0"), F.max("side").alias("s1"), F.first("same").alias("same")
    ).where("hub <> other and (same or s0 <> s1)")
    return subsets.select("k1", "k2", "fp").join(hubs.select("k1", "k2", "hub"), ["k1", "k2"]).where("fp <> hub").select(
        F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


_SURVIVOR = "fp binary, n int, score double, sketch array<long>, prefix array<long>, elements binary"


class Shard:
    """Distinct heavy sets of a shard."""

    def __init__(self, texts: pa.Table, shingle: int, least: int, buckets: int):
        self.take(Sets(X.merged(texts)["text"], shingle), least, buckets)

    def take(self, s: Sets, least: int, buckets: int) -> None:
        keys = s.keys()
        first = {k: r for r, k in reversed(list(enumerate(keys)))}
        self.rows = np.array(sorted(r for r in first.values() if s.sizes[r] >= least), np.int64)
        self.sets, self.keys = s, keys
        self.sizes = s.sizes[self.rows]
        self.bounds = np.r_[0, np.cumsum(self.sizes)]
        at = np.repeat(s.bounds[self.rows] - self.bounds[:-1], self.sizes)
        at += np.arange(self.bounds[-1])
        self.elements = s.elements[at]
        del at
        self.outbox = X.Outbox(self.elements, buckets, short=True)

    def survivors(self, replies: pa.Table, t: tuple[int, int]) -> pa.Table:
        out = [r[1:] for r in self.partnered(replies, t)]
        kinds = [("fp", pa.binary()), ("n", pa.int32()), ("score", pa.float64()), ("sketch", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("elements", pa.binary())]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})

    def partnered(self, replies: pa.Table, t: tuple[int, int]) -> list[tuple]:
        """(row, fp, n, score, sketch, prefix, elements) of the sets that may have a partner."""
        df = self.outbox.totals(replies)[self.outbox.number].astype(np.int64)
        shared = np.add.reduceat(df > 1, self.bounds[:-1], dtype=np.int64) if len(self.rows) else np.zeros(0, np.int64)
        least = -(-t[0] * self.sizes // t[1])
        out = []
        for i in np.flatnonzero(shared >= least):
            a, b = self.bounds[i], self.bounds[i + 1]
            own, freq = self.elements[a:b], df[a:b]
            order = np.argsort(freq, kind="stable")[: b - a - least[i] + 1]  # ties in hash order
            prefix = own[order[freq[order] > 1]]
            if len(prefix):
                bits = np.bincount((own % W.U64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1
                out.append((
                    int(self.rows[i]), self.keys[self.rows[i]], int(b - a), float(np.log2(freq).mean()), np.packbits(bits).view(np.int64).tolist(),
                    prefix.view(np.int64).tolist(), own.tobytes(),
                ))
        return out


def heavy_sets(docs: DataFrame, text: str, least: int, shingle: int = SHINGLE, t: tuple[int, int] = THRESHOLD, shards: int | None = None) -> DataFrame:
    """Distinct sets of ``least`` shingles or more that may have a partner, with
    those of their rarest shingles (``prefix``) that other sets hold too."""
    shards = shards or X.n_shards(docs, text, SHARD_BYTES)
    buckets = X.n_buckets(shards * (X.SHARD_BYTES // 2) // 6)
    by_shard = X.distinct_texts(docs, shards, text).groupBy("shard")

    def send(key, texts):
        return Shard(texts, shingle, least, buckets).outbox.messages(key[0].as_py())

    def answer(key, texts, replies):
        return Shard(texts, shingle, least, buckets).survivors(replies, t)

    replies = X.tally(by_shard.applyInArrow(W.lean2(send), X.MESSAGE), 4)
    return by_shard.cogroup(replies.groupBy("shard")).applyInArrow(W.lean3(answer), _SURVIVOR)


def _may_link(x: str, y: str, t: tuple[int, int]):
    """Size and sketch conditions, both necessary for a link."""
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    differ = sum(
        (F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0)
    )
    # |A| + |B| - 2 |A and B| is at most (den - num) / (den + num) of |A| + |B|
    return (F.least(nx, ny) * t[1] >= F.greatest(nx, ny) * t[0]) & (differ * (t[0] + t[1]) <= (nx + ny) * (t[1] - t[0]))


def verify(pairs: DataFrame, sets: DataFrame, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Of the pairs (a, b) of set names, those that reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):  # views, not copies, of the elements
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                keep.append(t[1] * common >= t[0] * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("elements").alias("x")), "a")
    both = one.join(sets.select(F.col("fp").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(W.lean(run), "a binary, b binary")


def heavy_links(sets: DataFrame, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Links that connect the heavy sets (a written table of ``heavy_sets``) as all
    links would: scans of the inverted lists, hub first."""
    lists = sets.select("fp", "n", "score", "sketch", F.explode("prefix").alias("e"))
    hubs = lists.groupBy("e").agg(F.max(F.struct("score", "fp", "n", "sketch")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1")
    hubs = reliable_checkpoint(hubs.select("e", F.col("h.fp").alias("fp"), F.col("h.n").alias("n"), F.col("h.sketch").alias("sketch")))
    first = (
        lists.alias("x").join(hubs.alias("y"), "e").where(F.col("x.fp") != F.col("y.fp")).where(_may_link("x", "y", t))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    )
    links = reliable_checkpoint(verify(first, sets, t))
    # members without a link to their list's hub meet all others of the list
    inside = links.select(F.col("a").alias("fp"), F.col("b").alias("hub"), F.lit(True).alias("inside"))
    placed = lists.join(hubs.select("e", F.col("fp").alias("hub")), "e").where("fp <> hub").join(inside, ["fp", "hub"], "left")
    placed = reliable_checkpoint(placed.withColumn("inside", F.coalesce("inside", F.lit(False))))
    second = (
        placed.where("not inside").alias("x").join(placed.alias("y"), "e")
        .where("x.fp <> y.fp and (y.inside or x.fp < y.fp)")
        .where(_may_link("x", "y", t))
        .select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
    )
    return links.unionByName(verify(second, sets, t))


def jaccard_components(
    docs: DataFrame, keep: list[str], id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, t: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """``keep`` columns, ``n_shingles`` and ``component_id``, the smallest id that
    links reach (its own for an empty set)."""
    ids = [*keep, id_column]
    rows = reliable_checkpoint(set_table(docs, ids, text, shingle))
    own = f"c{len(keep)}"
    small = rows.where(F.col("n_shingles").between(1, MOST_LIGHT)).groupBy("n_shingles").agg(F.count(F.lit(1)).alias("m")).collect()
    more = rows.where(F.col("n_shingles") > MOST_LIGHT).count()
    boundary = choose_boundary({**{r["n_shingles"]: r["m"] for r in small}, MOST_LIGHT + 1: more}, t)
    sets = reliable_checkpoint(heavy_sets(docs, text, first_heavy(boundary, t), shingle, t).dropDuplicates(["fp"]))
    links = light_links(rows, boundary, t).unionByName(heavy_links(sets, t))
    component = connected_components(links)
    classes = rows.where("n_shingles > 0").groupBy("fp").agg(F.min(own).alias("least"))
    placed = classes.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "component").select("fp", "component_id")
    kept = [f"c{i}" for i in range(len(keep))]
    linked = rows.where("n_shingles > 0").join(named, "fp").select(*kept, "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select(*kept, "n_shingles", F.col(own).alias("component_id"))
    return linked.unionByName(alone).toDF(*keep, "n_shingles", "component_id")
