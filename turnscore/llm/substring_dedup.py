"""Substring dedup by difference-cover anchors.

Words are those between blanks. Any two equal runs of ``length`` words share an
anchor: a shorter window that starts, in both, at a position whose remainder
modulo the period belongs to a difference cover. So only windows at cover
positions (5 of 21) are hashed and counted over the corpus. A repeated anchor
is then extended: the windows of ``length`` words around it are fingerprinted
(128 bits) and counted over the corpus in turn; every word inside a window that
occurs more than once goes.

Equal texts are handled once, with their number of copies: every window of a
text with a second copy is repeated.

Cases: null and empty texts have no words; a text of fewer words than a window
keeps all; repeated rows are copies of one another; repeats inside one document
(overlapping ones too) count; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import exchange as X
from turnscore.llm import words as W

LENGTH = 35
PERIOD = 21
#: A perfect difference set modulo 21 (every shift is a difference of two members).
COVER = (0, 1, 4, 14, 16)

_RESULT = "h1 long, h2 long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cover() -> np.ndarray:
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    mask = np.zeros(PERIOD, bool)
    mask[list(COVER)] = True
    return mask


class Shard:
    """Words of a shard's distinct texts, and its windows."""

    def __init__(self, texts: pa.Table, length: int, buckets: tuple[int, int]):
        self.texts = X.merged(texts)
        self.length = length
        self.words = W.split(self.texts["text"], n_hashes=2)
        self.copies = self.texts["copies"].to_numpy()
        self.row = self.words.rows
        n = len(self.row)
        place = np.arange(n) - self.words.bounds[self.row]
        left = self.words.bounds[self.row + 1] - np.arange(n)
        size = length - PERIOD + 1
        self.anchor_at = np.flatnonzero(_cover()[place % PERIOD] & (left >= size) & (np.diff(self.words.bounds)[self.row] >= length))
        self.anchors = X.Outbox(W.window_hash(self.words.hashes[0], self.anchor_at, size, W.WINDOW_BASES[0]), buckets[0], short=True)
        self.left, self.buckets = left, buckets

    def anchor_messages(self, shard: int) -> pa.Table:
        counts = np.zeros(len(self.anchors.keys), np.int64)
        np.add.at(counts, self.anchors.number, np.minimum(self.copies, 255)[self.row[self.anchor_at]])
        return self.anchors.messages(shard, counts)

    def windows(self, replies: pa.Table) -> None:
        """The windows of full length around repeated anchors."""
        repeated = self.anchor_at[self.anchors.totals(replies)[self.anchors.number] > 1]
        n = len(self.row)
        near = np.zeros(n + 1, np.int64)
        first = np.maximum(repeated - (PERIOD - 1), self.words.bounds[self.row[repeated]] if len(repeated) else 0)
        np.add.at(near, first, 1)
        np.add.at(near, repeated + 1, -1)
        self.window_at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= self.length))
        a = W.window_hash(self.words.hashes[0], self.window_at, self.length, W.WINDOW_BASES[0])
        b = W.window_hash(self.words.hashes[1], self.window_at, self.length, W.WINDOW_BASES[1])
        self.outbox = X.Outbox(a, self.buckets[1], extra=b)

    def window_messages(self, shard: int) -> pa.Table:
        counts = np.zeros(len(self.outbox.keys), np.int64)
        np.add.at(counts, self.outbox.number, np.minimum(self.copies, 255)[self.row[self.window_at]])
        return self.outbox.messages(shard, counts)

    def results(self, replies: pa.Table) -> pa.Table:
        repeated = self.window_at[self.outbox.totals(replies)[self.outbox.number] > 1]
        n = len(self.row)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + self.length, -1)
        keep = np.cumsum(cover[:-1]) <= 0
        data, (starts, ends) = self.words.data.tobytes(), (self.words.starts, self.words.ends)
        kept, digest, removed = [], [], []
        for r in range(len(self.words.bounds) - 1):
            a, b = self.words.bounds[r], self.words.bounds[r + 1]
            own = a + np.flatnonzero(keep[a:b])
            text = b" ".join([data[i:j] for i, j in zip(starts[own].tolist(), ends[own].tolist())])
            kept.append(text.decode("utf-8", "replace"))
            digest.append(hashlib.sha256(text).hexdigest())
            removed.append(int(b - a - len(own)))
        return pa.table(
            {"h1": self.texts["h1"], "h2": self.texts["h2"], "n_words": pa.array(np.diff(self.words.bounds), pa.int64()),
             "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.string())}
        )


def repeated_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Per distinct text (keys ``h1``, ``h2`` as by ``exchange.text_key``):
    ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept``, the kept words
    joined by one blank."""
    if length < PERIOD:
        raise ValueError(f"runs of {length} words are shorter than the period {PERIOD}")
    shards = shards or X.n_shards(docs, text)
    words = shards * X.SHARD_BYTES // 6
    buckets = (X.n_buckets(words * len(COVER) // PERIOD), X.n_buckets(words // 3))
    texts = X.distinct_texts(docs, shards, text)
    by_shard = texts.groupBy("shard")

    def send_anchors(key, t):
        return Shard(t, length, buckets).anchor_messages(key[0].as_py())

    def send_windows(key, t, replies):
        s = Shard(t, length, buckets)
        s.windows(replies)
        return s.window_messages(key[0].as_py())

    def finish(key, t, replies):
        s = Shard(t, length, buckets)
        kind = replies["kind"].to_numpy()
        s.windows(replies.filter(pa.array(kind == 0)))
        return s.results(replies.filter(pa.array(kind == 1)))

    anchors = X.tally(by_shard.applyInArrow(W.lean2(send_anchors), X.MESSAGE), 4)
    sent = by_shard.cogroup(anchors.groupBy("shard")).applyInArrow(W.lean3(send_windows), X.MESSAGE)
    windows = X.tally(sent, 16)
    both = anchors.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    return by_shard.cogroup(both.groupBy("shard")).applyInArrow(W.lean3(finish), _RESULT)


def dedup_substrings(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``keep`` columns and the results of the row's text; with ``with_text`` also
    ``kept``, the text that stays."""
    out = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], *X.text_key(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    )
    found = repeated_runs(docs.select(F.col(f"`{text}`").alias("text")), length=length).select("h1", "h2", *out)
    return rows.join(found, ["h1", "h2"]).select(*kept, *out).toDF(*keep, *out)
