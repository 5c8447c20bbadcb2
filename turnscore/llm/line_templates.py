"""Line dedup by a log-template tree.

A line's words are its fields. The tree has a fixed depth: number of fields,
then the leading ``DEPTH`` fields, where a field with a digit counts as the
variable ``<*>``. In a leaf, a field stays constant if at least ``LEAST_DOCS``
documents have it at its place; every other field is a variable too. The
fields so generalised are the line's template. A template with at least
``CONSTANT`` of its fields constant that recurs in ``LEAST_DOCS`` documents or
more is boilerplate, and all its lines are dropped from all documents.

Copies and near copies of one document do not make its lines recur: a group of
near copies by the rule of ``ngram_join`` counts as one document for what any of
its texts holds.

Texts are parsed twice, shard by shard. First a shard sends its leaves and its
shingles to be counted over the corpus (see ``exchange``). A leaf's count of
distinct texts bounds its count of groups from above, so the second time only
lines of leaves that recur by it are kept, as hashes of their fields, together
with what the join needs to name the near copies. All further counts are of
groups and work on these few lines alone: leaves, constant fields, templates.
Each is a count of distinct (value, group) pairs, so a value that a third of all
texts hold is spread over all tasks; counts are 64 bits wide.

Cases: null and empty texts have no lines; blank lines are kept and are part of
no template; a line repeated inside one document counts once; repeated rows are
copies; texts without words have no near copies; a document may end up empty; extra columns are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import exchange as X
from turnscore.llm import ngram_join as J
from turnscore.llm import words as W
from turnscore.llm.components import connected_components
from turnscore.session import reliable_checkpoint

DEPTH = 2
LEAST_DOCS = 10
#: Least share of constant fields, as a fraction.
CONSTANT = (7, 10)

_VARIABLE = W.U64(0x2545F4914F6CDD1D)
#: Text of a shard: sets and lines are taken apart at once, so it is half of what other operators take.
SHARD_BYTES = X.SHARD_BYTES // 2
_SETS, _LEAVES = 0, 1
_MESSAGE = "kind int, bucket int, shard int, entries binary, counts binary"
_REPLY = "shard int, kind int, bucket int, totals binary"
_PARSED = (
    "h1 long, h2 long, fp binary, n int, score double, sketch array<long>, prefix array<long>, elements binary, "
    "line array<int>, leaf array<long>, fields array<array<long>>"
)


def _capitals(data: np.ndarray, w: W.Words) -> np.ndarray:
    """A fingerprint of where each word has capitals (0: nowhere), which tells
    words apart whose lower-cased hashes are equal."""
    at = np.flatnonzero((data >= 65) & (data <= 90))
    word = np.searchsorted(w.starts, at, side="right") - 1
    out = np.zeros(len(w.starts), np.uint64)
    if len(at):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = W.mix(np.add.reduceat(W.mix((at - w.starts[word]).astype(np.uint64) + W.U64(1)), first))
    return out


class Shard:
    """A shard's distinct texts: their shingle sets and the leaves of their lines."""

    def __init__(self, texts: pa.Table, set_buckets: int, leaf_buckets: int):
        self.texts = X.merged(texts)
        lower = W.split(self.texts["text"], lower=True)
        self.sets = J.Shard.__new__(J.Shard)
        self.sets.take(J.Sets(None, J.SHINGLE, lower), 1, set_buckets)
        data, offsets = W.utf8(self.texts["text"])
        w, row = lower, lower.rows
        digit = np.r_[np.int32(0), np.cumsum((data >= 48) & (data <= 57), dtype=np.int32)]
        self.fields = np.where(digit[w.ends] > digit[w.starts], _VARIABLE, w.hashes[0] + _capitals(data, w))
        breaks = np.r_[np.int32(0), np.cumsum(data == 10, dtype=np.int32)]
        line = breaks[w.starts] - breaks[offsets[row]]
        new = np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])] if len(row) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.start, len(row)])
        self.row, self.line = row[self.start], line[self.start]
        lead = np.minimum(self.size, DEPTH)
        leaf = np.zeros(len(self.start), np.uint64)
        for d in range(1, DEPTH + 1):
            of = lead == d
            if of.any():
                leaf[of] = W.window_hash(self.fields, self.start[of], d, W.WINDOW_BASES[0])
        self.leaf = W.mix(leaf + self.size.astype(np.uint64))
        self.leaves = X.Outbox(self.leaf, leaf_buckets)

    def messages(self, shard: int) -> pa.Table:
        """Distinct shingles and leaves, each leaf with the number of texts that hold it."""
        sets = self.sets.outbox.messages(shard)
        box = self.leaves
        order = np.lexsort((self.row, box.number))
        n, r = box.number[order], self.row[order]
        once = np.r_[True, (n[1:] != n[:-1]) | (r[1:] != r[:-1])] if len(n) else np.zeros(0, bool)
        counts = np.bincount(n[once], minlength=len(box.keys)).astype(np.int64)
        cuts = [(b, box.bounds[b], box.bounds[b + 1]) for b in np.flatnonzero(np.diff(box.bounds)).tolist()]
        leaves = pa.table({
            "bucket": pa.array([b for b, _, _ in cuts], pa.int32()), "shard": pa.array([shard] * len(cuts), pa.int32()),
            "entries": pa.array([box.keys[i:j].tobytes() for _, i, j in cuts], pa.binary()),
            "counts": pa.array([counts[i:j].tobytes() for _, i, j in cuts], pa.binary()),
        })
        kinds = pa.array([_SETS] * len(sets) + [_LEAVES] * len(leaves), pa.int32())
        return pa.concat_tables([sets, leaves]).add_column(0, "kind", kinds)

    def parsed(self, replies: pa.Table, least: int) -> pa.Table:
        """Per text: its set, what the join needs where it may have a partner, and
        the lines of leaves that ``least`` texts hold."""
        kind = replies["kind"].to_numpy()
        partnered = {r[0]: r for r in self.sets.partnered(replies.filter(pa.array(kind == _SETS)), J.THRESHOLD)}
        own = replies.filter(pa.array(kind == _LEAVES))
        total = np.zeros(len(self.leaves.keys), np.int64)
        for b, body in zip(own["bucket"].to_pylist(), own["totals"].to_pylist()):
            total[self.leaves.bounds[b] : self.leaves.bounds[b + 1]] = np.frombuffer(body, np.int64)
        often = np.flatnonzero(total[self.leaves.number] >= least)
        n = self.texts.num_rows
        cut = np.searchsorted(self.row[often], np.arange(n + 1))
        size = self.size[often]
        first = np.r_[0, np.cumsum(size)]
        at = np.repeat(self.start[often] - first[:-1], size) + np.arange(first[-1])
        offsets = pa.array(cut.astype(np.int32))
        fields = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(self.fields[at].view(np.int64)))
        s = self.sets.sets
        none = (None,) * 7
        rows = [partnered.get(i, none) for i in range(n)]
        small = [
            r[6] if r[6] is not None else s.elements[a:b].tobytes() if 0 < b - a <= J.MOST_LIGHT else None
            for r, a, b in zip(rows, s.bounds[:-1].tolist(), s.bounds[1:].tolist())
        ]
        return pa.table({
            "h1": self.texts["h1"], "h2": self.texts["h2"], "fp": pa.array(self.sets.keys, pa.binary()), "n": pa.array(s.sizes, pa.int32()),
            "score": pa.array([r[3] for r in rows], pa.float64()), "sketch": pa.array([r[4] for r in rows], pa.list_(pa.int64())),
            "prefix": pa.array([r[5] for r in rows], pa.list_(pa.int64())), "elements": pa.array(small, pa.binary()),
            "line": pa.ListArray.from_arrays(offsets, pa.array(self.line[often].astype(np.int32))),
            "leaf": pa.ListArray.from_arrays(offsets, pa.array(self.leaf[often].view(np.int64))),
            "fields": pa.ListArray.from_arrays(offsets, fields),
        })


def tally(messages: DataFrame) -> DataFrame:
    """Replies (shard, kind, bucket, totals): how often each entry was sent."""

    def run(key, table: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        table = table.sort_by("shard")
        bodies, shards = table["entries"].to_pylist(), table["shard"].to_pylist()
        entry, count, answer = (np.uint32, np.uint8, np.uint16) if kind == _SETS else (np.uint64, np.int64, np.int64)
        keys = np.frombuffer(b"".join(bodies), entry)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), count).astype(np.int64)
        order = np.argsort(keys)
        k = keys[order]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sums = np.add.reduceat(counts[order], start)
        if kind == _SETS:  # only which shingles are rarer and which are alone matters
            sums = np.minimum(sums, np.iinfo(answer).max)
        total = np.empty(len(order), answer)
        total[order] = np.repeat(sums.astype(answer), np.diff(np.r_[start, len(order)]))
        width = keys.dtype.itemsize
        ends = np.cumsum([len(b) // width for b in bodies])
        return pa.table({
            "shard": pa.array(shards, pa.int32()), "kind": pa.array([kind] * len(shards), pa.int32()), "bucket": pa.array([bucket] * len(shards), pa.int32()),
            "totals": pa.array([total[e - len(b) // width : e].tobytes() for b, e in zip(bodies, ends)], pa.binary()),
        })

    return messages.groupBy("kind", "bucket").applyInArrow(W.lean2(run), _REPLY)


def parse(docs: DataFrame, text: str, least: int, shards: int | None = None) -> DataFrame:
    """The second parse of every distinct text (``_PARSED``), written once."""
    shards = shards or X.n_shards(docs, text, SHARD_BYTES)
    set_buckets, leaf_buckets = X.n_buckets(shards * SHARD_BYTES // 6), X.n_buckets(shards * SHARD_BYTES // 60)
    by_shard = X.distinct_texts(docs, shards, text).groupBy("shard")

    def send(key, texts):
        return Shard(texts, set_buckets, leaf_buckets).messages(key[0].as_py())

    def keep(key, texts, replies):
        return Shard(texts, set_buckets, leaf_buckets).parsed(replies, least)

    replies = tally(by_shard.applyInArrow(W.lean2(send), _MESSAGE))
    return reliable_checkpoint(by_shard.cogroup(replies.groupBy("shard")).applyInArrow(W.lean3(keep), _PARSED))


def group_names(parsed: DataFrame) -> DataFrame:
    """(fp, name): the group of near copies that a set belongs to, for the sets
    that have a partner; others are groups of their own."""
    sets = parsed.where("n > 0").select("fp", F.col("n").cast("long").alias("n_shingles"), "elements", "score", "sketch", "prefix")
    small = parsed.where(F.col("n").between(1, J.MOST_LIGHT)).groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()
    more = parsed.where(F.col("n") > J.MOST_LIGHT).count()
    boundary = J.choose_boundary({**{r["n"]: r["m"] for r in small}, J.MOST_LIGHT + 1: more})
    heavy = sets.where(F.col("prefix").isNotNull() & (F.col("n_shingles") >= J.first_heavy(boundary))).withColumn("n", F.col("n_shingles").cast("int"))
    heavy = reliable_checkpoint(heavy.drop("n_shingles").dropDuplicates(["fp"]))
    links = J.light_links(sets, boundary).unionByName(J.heavy_links(heavy))
    return connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("name"))


def _in_groups(rows: DataFrame, of: list[str], least: int) -> DataFrame:
    """The values ``of`` that ``least`` groups hold, or more."""
    return rows.select(*of, "name").distinct().groupBy(*of).agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") >= least).drop("groups")


def recurring_lines(docs: DataFrame, text: str = "text", least: int = LEAST_DOCS, shards: int | None = None) -> DataFrame:
    """Per distinct text (keys ``h1``, ``h2``) with lines to drop: their numbers
    (0-based)."""
    parsed = parse(docs, text, least, shards)
    lines = parsed.where(F.size("line") > 0).select("h1", "h2", "fp", F.inline(F.arrays_zip("line", "leaf", "fields")))
    lines = lines.join(group_names(parsed), "fp", "left").withColumn("name", F.coalesce("name", "fp")).drop("fp")
    lines = reliable_checkpoint(lines)
    # written tables: few leaves and templates are broadcast, so one that many lines share stays where its lines are
    lines = lines.join(reliable_checkpoint(_in_groups(lines, ["leaf"], least)), "leaf")
    variable = F.lit(int(_VARIABLE.view(np.int64)))
    places = lines.select("h1", "h2", "line", "leaf", "name", F.size("fields").alias("n"), F.posexplode("fields").alias("place", "value"))
    places = places.where(F.col("value") != variable)
    constant = places.join(_in_groups(places, ["leaf", "place", "value"], least), ["leaf", "place", "value"], "left_semi")
    # a template is told by two hashes over the constant fields and their places; sums of fixed size, unlike lists, merge before the shuffle
    hashes = [F.bit_xor(F.xxhash64(*salt, "place", "value")).alias(t) for t, salt in (("t1", []), ("t2", [F.lit("second")]))]
    found = constant.groupBy("h1", "h2", "line", "leaf", "name", "n").agg(F.count(F.lit(1)).alias("constants"), *hashes)
    found = reliable_checkpoint(found.where(F.col("constants") * CONSTANT[1] >= F.col("n") * CONSTANT[0]).drop("n", "constants"))
    gone = found.join(reliable_checkpoint(_in_groups(found, ["leaf", "t1", "t2"], least)), ["leaf", "t1", "t2"], "left_semi")
    return gone.groupBy("h1", "h2").agg(F.collect_list("line").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", least: int = LEAST_DOCS) -> DataFrame:
    """The documents with their recurring lines dropped from ``text`` (null stays
    null), plus ``n_lines`` and ``n_dropped``."""
    taken = [c for c in docs.columns if c in ("n_lines", "n_dropped")]
    columns = [c for c in docs.columns if c not in taken]
    found = recurring_lines(docs.select(F.col(f"`{text}`").alias("text")), least=least)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns if c != text]).alias("_row") if len(columns) > 1 else F.lit(None).cast("string").alias("_row"),
        F.col(f"`{text}`").alias("_text"), *X.text_key(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
    )
    lines = F.split("_text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("dropped", i)), "\n")
    breaks = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit("")))  # without a second split
    n_lines = F.when(F.coalesce(F.length("_text"), F.lit(0)) > 0, breaks + 1).otherwise(0).cast("long")
    out = rows.join(found.select("h1", "h2", "dropped"), ["h1", "h2"], "left").select(
        "_row", F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(left).alias("_kept"), n_lines.alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*[F.col("_kept").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns], "n_lines",
                      F.when(F.col("n_dropped") > 0, F.col("n_dropped")).otherwise(0).alias("n_dropped"))
