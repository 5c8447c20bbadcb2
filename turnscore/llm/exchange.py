"""Whole-corpus counts of fingerprints, asked shard by shard.

A shard is a set of distinct texts (by hash of the text), small enough for one
task. To learn how often each of its fingerprints occurs anywhere, a shard
sends its distinct ones, packed, to buckets by hash range; a bucket adds up
what all shards sent and answers each in the order sent. A shard sends a
fingerprint once however often it holds it, so a fingerprint that a third of
all rows share costs one entry per shard, and no bucket grows with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W
from turnscore.llm.words import U64

SHARD_BYTES = 4 << 20
#: Distinct texts handed on at a time.
TOGETHER = 1024
#: Entries that a bucket should hold on average.
BUCKET_ENTRIES = 1 << 19

MESSAGE = "bucket int, shard int, entries binary, counts binary"
REPLY = "shard int, bucket int, totals binary"


def n_shards(docs: DataFrame, text: str = "text", size: int = SHARD_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(1, -(-total // size))


def distinct_texts(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """(shard, h1, h2, text, copies): texts by shard. Equal texts are merged
    batch by batch before they are shuffled, so a hot text reaches its shard
    once per batch; ``merged`` joins the rest. Null texts are empty texts."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), *text_key(F.col("text")), "text"
    )

    def run(batches):
        for batch in batches:
            keys = pa.Table.from_batches([batch.select(["h1", "h2"])]).append_column("i", pa.array(np.arange(batch.num_rows)))
            g = keys.group_by(["h1", "h2"]).aggregate([("i", "min"), ("i", "count")]).sort_by("i_min")
            for at in range(0, g.num_rows, TOGETHER):  # no second copy of a whole batch
                part = g.slice(at, TOGETHER)
                first = batch.take(part["i_min"].combine_chunks())
                yield pa.record_batch([*[first.column(c) for c in ("shard", "h1", "h2", "text")], part["i_count"].combine_chunks().cast(pa.int64())],
                                      names=["shard", "h1", "h2", "text", "copies"])

    return rows.mapInArrow(W.lean(run), "shard int, h1 long, h2 long, text string, copies long")


def text_key(text):
    """128 bits that stand for a whole text: two hashes of it with different
    seeds (a later column's hash starts from the one before, so the salt goes first)."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def merged(texts: pa.Table) -> pa.Table:
    """A shard's distinct texts in an order that depends on the texts alone."""
    t = texts.append_column("i", pa.array(np.arange(texts.num_rows)))
    g = t.group_by(["h1", "h2"]).aggregate([("i", "min"), ("copies", "sum")]).sort_by([("h1", "ascending"), ("h2", "ascending")])
    return t.take(g["i_min"]).select(["h1", "h2", "text"]).append_column("copies", g["copies_sum"])


def n_buckets(entries: int) -> int:
    return max(1, -(-entries // BUCKET_ENTRIES))


class Outbox:
    """Distinct entries of a shard in sending order.

    ``keys`` are 64-bit fingerprints; the high bits choose the bucket. ``extra``
    (optional, 64 bits more) makes the entry 128 bits wide. With ``short`` an
    entry is the 32 bits below the bucket's: enough where a rare false match
    only costs work."""

    def __init__(self, keys: np.ndarray, buckets: int, extra: np.ndarray | None = None, short: bool = False):
        self.buckets = buckets
        if short:
            bucket = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
            keys = (bucket << U64(32)) | (keys & U64(0xFFFFFFFF))
        order = np.lexsort((extra, keys)) if extra is not None else np.argsort(keys)
        k = keys[order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        if extra is not None and len(k):
            e = extra[order]
            new |= np.r_[True, e[1:] != e[:-1]]
        self.number = np.empty(len(k), np.int64)  # of each given key among the distinct ones
        self.number[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.counts = np.diff(np.r_[at, len(k)])
        self.keys = k[at]
        self.extra = extra[order][at] if extra is not None else None
        self.short = short
        bucket_of = self.keys >> U64(32) if short else ((self.keys >> U64(32)) * U64(buckets)) >> U64(32)
        self.bounds = np.searchsorted(bucket_of, np.arange(buckets + 1).astype(U64))

    def messages(self, shard: int, multiplicity: np.ndarray | None = None) -> pa.Table:
        """One row per bucket that gets entries."""
        counts = np.minimum(self.counts if multiplicity is None else multiplicity, 255).astype(np.uint8)
        rows = []
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            i, j = self.bounds[b], self.bounds[b + 1]
            if self.short:
                body = self.keys[i:j].astype(np.uint32).tobytes()
            elif self.extra is not None:
                body = np.stack([self.keys[i:j], self.extra[i:j]], axis=1).tobytes()
            else:
                body = self.keys[i:j].tobytes()
            rows.append((b, shard, body, counts[i:j].tobytes()))
        return pa.table(
            {"bucket": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()),
             "entries": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())}
        )

    def totals(self, replies: pa.Table) -> np.ndarray:
        """The answer for each distinct key, in sending order (capped at 65535)."""
        out = np.zeros(len(self.keys), np.uint16)
        for b, body in zip(replies["bucket"].to_pylist(), replies["totals"].to_pylist()):
            out[self.bounds[b] : self.bounds[b + 1]] = np.frombuffer(body, np.uint16)
        return out


def tally(messages: DataFrame, width: int) -> DataFrame:
    """Replies (shard, bucket, totals) to messages with entries of ``width`` bytes."""

    def run(key, table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        bodies, shards = table["entries"].to_pylist(), table["shard"].to_pylist()
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).astype(np.int64)
        flat = b"".join(bodies)
        if width == 16:
            both = np.frombuffer(flat, np.uint64).reshape(-1, 2)
            order = np.lexsort((both[:, 1], both[:, 0]))
            s = both[order]
            new = np.r_[True, (s[1:] != s[:-1]).any(axis=1)]
        else:
            keys = np.frombuffer(flat, np.uint32 if width == 4 else np.uint64)
            order = np.argsort(keys)
            s = keys[order]
            new = np.r_[True, s[1:] != s[:-1]]
        start = np.flatnonzero(new)
        sums = np.minimum(np.add.reduceat(counts[order], start), 65535).astype(np.uint16)
        total = np.empty(len(order), np.uint16)
        total[order] = np.repeat(sums, np.diff(np.r_[start, len(order)]))
        ends = np.cumsum([len(b) // width for b in bodies])
        bucket = table["bucket"][0].as_py()
        return pa.table(
            {"shard": pa.array(shards, pa.int32()), "bucket": pa.array([bucket] * len(shards), pa.int32()),
             "totals": pa.array([total[e - len(b) // width : e].tobytes() for b, e in zip(bodies, ends)], pa.binary())}
        )

    return messages.groupBy("bucket").applyInArrow(W.lean2(run), REPLY)
