"""Vector code compression: product codes found by slice-and-intersect bitmasks.

A vector of integers ``floor(256 x)`` is cut into ``PARTS`` equal consecutive
parts, and every part is replaced by the number of the nearest entry (squared
Euclidean distance, ties to the lower number) of its position's codebook of at
most 64 entries.

Nearest entries are searched exactly and without comparing all of them: per
dimension the entries' coordinates are sorted, and prefix masks say which
entries lie among the first k. A radius around a part's coordinate selects a
range per dimension; the exclusive or of the two prefix masks at its ends is
the range's entry mask, and the AND over the dimensions leaves as candidates
the entries inside a box that holds the ball of that radius. The initial radius
is the typical distance of the batch's first parts; a part whose best candidate
lies farther than its radius, or that has none, is asked again with a radius
that is certain (that candidate's distance) or doubled.

Codebooks start from the parts of the smallest ids. Each round sums the parts of
each entry inside the tasks, so a task sends one row per entry and place
however many vectors it holds; only codebooks come to the driver.

Cases: rows whose vector is null or empty or holds null or non-finite components are
dropped, as are those with a component beyond the bound that keeps distances
inside 64 bits (about 2**29 / sqrt(size) / 256); vectors of another length than
that of the smallest id, or of a length that the parts don't divide, get a null
code and error and teach nothing; ids that repeat are rows of their own (ties
for the first codebook by the vector); null ids come last; fewer rows than
entries make smaller codebooks; null labels count as one label; a total beyond 64 bits is null; an empty
table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W
from turnscore.session import reliable_checkpoint

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors coded at a time.
SLICE = 4096


def bound(size: int) -> int:
    """Components of at most this size keep all sums of squares below 2**60."""
    return int((2**58 / max(1, size)) ** 0.5)


class Codebook:
    """Entries (k x d integers) of one part position, with sorted coordinates
    and prefix masks."""

    def __init__(self, entries: np.ndarray):
        if not 0 < len(entries) <= 64:
            raise ValueError("a codebook has 1 to 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()
        bit = np.uint64(1) << order.T.astype(np.uint64)
        self.prefix = np.zeros((entries.shape[1], len(entries) + 1), np.uint64)
        np.bitwise_or.accumulate(bit, axis=1, out=self.prefix[:, 1:])

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Entry masks of the boxes of a radius around parts."""
        mask = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[j], x[:, j] - radius, side="left")
            high = np.searchsorted(self.sorted[j], x[:, j] + radius, side="right")
            mask &= self.prefix[j, high] ^ self.prefix[j, low]
        return mask

    def best(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest candidate of each part (-1: none) and its squared distance."""
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        code, least = np.full(len(x), -1), np.zeros(len(x), np.int64)
        if len(row):
            apart = x[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", apart, apart)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least[row[first]] = np.minimum.reduceat(distance, first)
            at = np.flatnonzero(distance == least[row])  # ties: candidates stand in order of their numbers
            owner = row[at]
            new = np.r_[True, owner[1:] != owner[:-1]]
            code[owner[new]] = entry[at[new]]
        return code, least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part (n x d)."""
        code, error = np.full(len(x), -1), np.zeros(len(x), np.int64)
        if not len(x):
            return code, error
        head = x[: min(len(x), 32)]
        apart = head[:, None, :] - self.entries[None]
        typical = np.sqrt(np.median((apart * apart).sum(axis=2).min(axis=1)))
        radius = np.full(len(x), max(1, int(np.ceil(typical))), np.int64)
        left = np.arange(len(x))
        while len(left):
            r = radius[left]
            found, distance = self.best(x[left], self.candidates(x[left], r))
            some = found >= 0
            sure = some & (distance <= r * r)
            code[left[sure]], error[left[sure]] = found[sure], distance[sure]
            radius[left] = np.where(some, np.ceil(np.sqrt(distance.astype(np.float64))).astype(np.int64) + 1, np.minimum(r * 2, 1 << 31))
            left = left[~sure]
        return code, error


def assign(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows x parts) of whole vectors."""
    d = x.shape[1] // len(books)
    found = [b.nearest(x[:, p * d : (p + 1) * d]) for p, b in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """``floor(256 x)`` of fixed-length lists."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size)


def usable(vector) -> F.Column:
    """Whether a vector is kept."""
    most = F.floor(F.sqrt(F.lit(2.0**58) / F.size(vector)))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < most))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _slices(batches, size: int):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, integers(part.column("_vector"), size)


def _sums(size: int, parts: int, shared):
    """Per task: count and component sums of the parts that each entry attracts."""
    d = size // parts

    def run(batches):
        books = [Codebook(e) for e in shared.value]
        k = len(books[0].entries)
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for _, x in _slices(batches, size):
            codes, _ = assign(x, books)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(total[p], codes[:, p], x[:, p * d : (p + 1) * d])
        p, e = np.nonzero(count)
        yield pa.record_batch(
            [pa.array(np.repeat(p, d).astype(np.int32)), pa.array(np.repeat(e, d).astype(np.int32)), pa.array(np.tile(np.arange(d), len(p)).astype(np.int32)),
             pa.array(np.repeat(count[p, e], d)), pa.array(total[p, e].ravel())],
            names=["part", "entry", "place", "n", "total"])

    return run


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (parts x entries x components) of rows (_id, _vector) of one length."""
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").toArrow()["_vector"].combine_chunks()
    books = list(integers(first, size).reshape(len(first), parts, -1).transpose(1, 0, 2))
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        found = rows.select("_vector").mapInArrow(W.lean(_sums(size, parts, shared)), "part int, entry int, place int, n long, total long")
        found = found.groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [b.copy() for b in books]
        for r in found.collect():  # one row per codebook component
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], size: int, parts: int = PARTS) -> DataFrame:
    """(_id, _label, code, error) of rows (_id, _label, _vector) of one length."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = [Codebook(e) for e in shared.value]
        for part, x in _slices(batches, size):
            codes, errors = assign(x, own)
            digits = codes.astype(np.uint8).tobytes().hex()
            step = 2 * parts
            yield pa.record_batch(
                [part.column("_id"), part.column("_label"), pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()), pa.array(errors.sum(axis=1))],
                names=["_id", "_label", "code", "error"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.select("_id", "_label").dtypes) + ", code string, error long"
    return rows.select("_id", "_label", "_vector").mapInArrow(W.lean(run), schema)


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Per usable row: id, label, ``code`` (two hex digits a part), ``error`` (squared
    distances summed) and ``label_error`` (error summed over equal labels); and the codebooks."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{label}`").alias("_label"), F.col(f"`{vector}`").alias("_vector"))
    rows = rows.where(usable(F.col("_vector")))
    least = rows.orderBy(F.col("_id").asc_nulls_last(), "_vector").select(F.size("_vector").alias("n")).first()
    size = least["n"] if least else 0
    fits = (F.size("_vector") == size) & F.lit(size % parts == 0)
    books: list[np.ndarray] = []
    odd = rows.where(~fits).select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = odd
    if size and size % parts == 0:
        own = rows.where(fits)
        books = fit(own, size, parts, entries, rounds)
        coded = encode(own, books, size, parts).unionByName(odd)
    # written once: read for the totals, which are as many as there are labels, and for the rows
    coded = reliable_checkpoint(coded)
    totals = coded.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    totals = reliable_checkpoint(totals.withColumnRenamed("_label", "_of"))
    out = coded.join(totals, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return out.select(F.col("_id").alias(id_column), F.col("_label").alias(label), "code", "error", "label_error"), books
