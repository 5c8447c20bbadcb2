"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside one partition (about ``SHARD_BYTES`` of
text); its index is built, searched and dropped in one task, so documents are
never shuffled. The index is over words: the Burrows-Wheeler transform of the
shard's word sequence in a wavelet matrix with ranks, and text positions
sampled at every ``SAMPLE``-th word. Every test phrase (a window of ``window``
consecutive words of a benchmark item; an item of fewer words is one phrase)
is matched by backward search, all phrases at once; occurrences are located by
walking back to the nearest sampled position; overlapping occurrences merge
into removal spans.

Texts that are equal within a shard are indexed once. A document of more words
than an index may hold is cut into pieces that overlap by the longest phrase
less one word, so no occurrence is lost and memory stays bounded.

Phrases travel by broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark
text; each further block is one more pass over the shards.

Cases: null or empty texts have no words and are clean; repeated rows are
judged one by one; a benchmark item that is null or without words matches
nothing; a null item id is listed as ``null``; items that share an id count
once; an empty benchmark leaves all documents clean; extra columns of the
documents are kept where they are named in ``keep``."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W

WINDOW = 10
#: Text of a shard; a Python worker holds about thirty times as much while it builds the index.
SHARD_BYTES = 2 << 20
#: Words of one index at most.
INDEX_WORDS = 1 << 20
SAMPLE = 8
BLOCK_BYTES = 32 << 20


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.n = len(seq)
        self.levels = []
        seq = seq.astype(np.uint32)
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> np.uint32(shift)) & np.uint32(1) != 0
            packed = np.zeros((self.n >> 6) + 1, np.uint64)
            packed.view(np.uint8)[: (self.n + 7) // 8] = np.packbits(bit, bitorder="little")
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = self.n - int(before[-1])
            self.levels.append((shift, packed, before, zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @staticmethod
    def _ones(level, i: np.ndarray) -> np.ndarray:
        _, packed, before, _ = level
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(packed[block] & low)

    def ranks(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """For each ``at``: how often the symbol occurs before that place."""
        places = [np.zeros_like(at[0]), *at]
        for level in self.levels:
            one = (symbol >> level[0]) & 1 == 1
            for j, p in enumerate(places):
                ones = self._ones(level, p)
                places[j] = np.where(one, level[3] + ones, p - ones)
        return [p - places[0] for p in places[1:]]

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), np.int64)
        for level in self.levels:
            ones = self._ones(level, i)
            bit = (level[1][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0
            symbol = symbol * 2 + bit
            i = np.where(bit, level[3] + ones, i - ones)
        return symbol


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose last symbol is unique: a sort by the
    first three symbols, then doubling of the compared length for the
    suffixes that are still tied."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length() if n else 1
    s = symbols.astype(np.int64)
    depth = 3 if bits <= 21 else 1
    key = s.copy()
    if depth == 3:
        key <<= 2 * bits
        key[:-1] |= s[1:] << bits
        key[:-2] |= s[2:]
    del s
    order = np.argsort(key)
    in_order = key[order]
    del key
    first = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
    del in_order
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    sizes = np.diff(np.r_[first, n])
    rank[order] = np.repeat(first, sizes)
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(tied):
        suffix = order[tied]
        own = rank[suffix]
        key = own * (n + 1) + rank[np.minimum(suffix + depth, n)] + 1
        by = np.argsort(key)
        order[tied] = suffix[by]
        in_order = key[by]
        new = np.r_[True, in_order[1:] != in_order[:-1]]
        start = np.flatnonzero(new)
        sizes = np.diff(np.r_[start, len(tied)])
        rank[order[tied]] = np.repeat(tied[start], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


class FMIndex:
    """Index of some word sequences given by their word hashes."""

    def __init__(self, pieces: list[np.ndarray], sample: int = SAMPLE):
        lengths = np.array([len(p) for p in pieces], np.int64)
        hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # a separator follows each piece
        self.vocabulary, word = _distinct(hashes)
        n, d = int(self.starts[-1]), len(pieces)
        separators = self.starts[1:] - 1
        text = np.empty(n, np.int64)
        is_word = np.ones(n, bool)
        is_word[separators] = False
        text[is_word] = word + d  # each separator is a symbol of its own, below all words
        text[separators] = np.arange(d)
        del hashes, is_word
        sa = suffix_order(text)
        previous = text[sa - 1]
        del text
        bwt = np.where((sa == 0) | (previous < d), 0, previous - d + 1)  # here all separators are 0
        del previous
        self.tree = WaveletMatrix(bwt, len(self.vocabulary) + 1)
        del bwt
        self.before = d + np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.vocabulary)))])
        inside = np.arange(n) - np.repeat(self.starts[:-1], lengths + 1)
        marked = (inside % sample == 0)[sa]
        self.mark = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.position = sa[marked]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in this index, or -1."""
        if not len(self.vocabulary):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges (from, to) of the phrases; ``phrases`` holds their symbols
        from the last word backwards."""
        low, high = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        known = (phrases >= 0) | (np.arange(phrases.shape[1]) >= lengths[:, None])
        alive = np.flatnonzero(known.all(axis=1) & (lengths > 0))
        if len(alive):
            last = phrases[alive, 0]
            low[alive], high[alive] = self.before[last], self.before[last + 1]
        for step in range(1, phrases.shape[1]):
            going = alive[lengths[alive] > step]
            if not len(going):
                break
            symbol = phrases[going, step]
            a, b = self.tree.ranks(symbol + 1, low[going], high[going])
            low[going], high[going] = self.before[symbol] + a, self.before[symbol] + b
            alive = np.concatenate([going[a < b], alive[lengths[alive] <= step]])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            found = self.mark[at]
            out[open_[found]] = self.position[self.mark_rank[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            if len(at):
                symbol = self.tree.access(at)
                at = self.before[symbol - 1] + self.tree.ranks(symbol, at)[0]
            steps += 1
        return out


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's number among them."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    order = np.argsort(values)
    v = values[order]
    new = np.r_[True, v[1:] != v[:-1]]
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(new) - 1
    return v[new], number


class Phrases:
    """Distinct phrases of some benchmark items: word hashes from the last word
    backwards, lengths, and the items of each phrase."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        w = W.split(pa.array(texts, pa.string()), W.NON_ALNUM, lower=True)
        h = w.hashes[0]
        found: dict[bytes, set[int]] = {}
        self.names = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.names)}
        for r, item in enumerate(ids):
            own = h[w.bounds[r] : w.bounds[r + 1]]
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                found.setdefault(own[i : i + window][::-1].tobytes(), set()).add(number[item])
        self.lengths = np.array([len(k) // 8 for k in found], np.int64)
        self.hashes = np.zeros((len(found), window), np.uint64)
        for i, k in enumerate(found):
            self.hashes[i, : len(k) // 8] = np.frombuffer(k, np.uint64)
        counts = np.array([len(v) for v in found.values()], np.int64)
        self.item_bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.items = np.array([x for v in found.values() for x in sorted(v)], np.int64)
        self.longest = int(self.lengths.max()) if len(found) else 1


def find(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Over the given rows of a batch: mask of the hit words, and distinct
    (row, item number) pairs."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    group: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if not group or not len(phrases.lengths):
            group, size = [], 0
            return
        index = FMIndex([hashes[a:b] for _, a, b in group])
        symbols = index.symbols(phrases.hashes)
        low, high = index.search(symbols, phrases.lengths)
        hit = np.flatnonzero(high > low)
        n = (high - low)[hit]
        which = np.repeat(hit, n)
        at = index.locate(np.repeat(low[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
        piece = np.searchsorted(index.starts, at, side="right") - 1
        word = at - index.starts[piece] + np.array([a for _, a, _ in group], np.int64)[piece]
        np.add.at(covered, word, 1)
        np.add.at(covered, word + phrases.lengths[which], -1)
        row = np.array([r for r, _, _ in group], np.int64)[piece]
        per = (phrases.item_bounds[1:] - phrases.item_bounds[:-1])[which]
        item = phrases.items[np.repeat(phrases.item_bounds[which] - np.r_[0, np.cumsum(per)[:-1]], per) + np.arange(per.sum())]
        pairs.append(np.unique(np.stack([np.repeat(row, per), item], axis=1), axis=0))
        group, size = [], 0

    for r in rows:
        a, b = int(bounds[r]), int(bounds[r + 1])
        while a < b:
            to = min(b, a + INDEX_WORDS)
            if size and size + to - a > INDEX_WORDS:
                flush()
            group.append((int(r), a, to))
            size += to - a
            if to == b:
                break
            a = to - (phrases.longest - 1)
    flush()
    return np.cumsum(covered[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _search(table: pa.Table, column: str, phrases: Phrases) -> pa.Table:
    """Adds, per row, the merged hit spans (word offsets, packed as 64-bit
    pairs) and the items found to the columns ``_spans`` and ``_items``."""
    w = W.split(table[column], W.NON_ALNUM, lower=True)
    _, offsets = W.utf8(table[column])
    _, first, same = np.unique(W.span_hash(w.data, offsets[:-1], offsets[1:], W.BASES[0]), return_index=True, return_inverse=True)
    hashes, bounds = w.hashes[0], w.bounds
    del w  # a worker's memory counts: nothing is held longer than it is needed
    hit, pairs = find(hashes, bounds, first, phrases)
    del hashes
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    inner = bounds[1:-1]
    begin, end = edge[:-1] == 1, edge[1:] == -1
    inner = inner[(inner > 0) & (inner < len(hit))]
    if len(inner):
        begin[inner] = hit[inner]
        end[inner - 1] = hit[inner - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    cut = np.searchsorted(begin, bounds)
    by_row = np.searchsorted(pairs[:, 0], np.arange(table.num_rows + 1))
    spans, items = [], []
    old_spans, old_items = table["_spans"].to_pylist(), table["_items"].to_pylist()
    for r in range(table.num_rows):
        f = first[same[r]]
        a, b = cut[f], cut[f + 1]
        own = (np.stack([begin[a:b], end[a:b]], axis=1) - bounds[f]).astype(np.int64)
        spans.append(old_spans[r] + own.tobytes())
        items.append(old_items[r] + [phrases.names[i] for i in pairs[by_row[f] : by_row[f + 1], 1]])
    at = table.schema.get_field_index
    return table.set_column(at("_spans"), "_spans", pa.array(spans, pa.binary())).set_column(
        at("_items"), "_items", pa.array(items, pa.list_(pa.string())))


def _merged(packed: bytes) -> np.ndarray:
    """Disjoint spans, in order, of packed (start, end) pairs; touching ones merge."""
    s = np.frombuffer(packed, np.int64).reshape(-1, 2)
    if len(s) < 2:
        return s
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    start = np.flatnonzero(new)
    return np.stack([s[start, 0], reach[np.r_[start[1:], len(s)] - 1]], axis=1)


def _finish(table: pa.Table, column: str, keep: list[str]) -> pa.RecordBatch:
    w = W.split(table[column], W.NON_ALNUM, lower=True, n_hashes=0)
    raw, offsets = W.utf8(table[column])
    n_words = np.diff(w.bounds)
    n_hit, n_items, digest, clean, spans_out, names_out = [], [], [], [], [], []
    packed, items = table["_spans"].to_pylist(), table["_items"].to_pylist()
    empty = hashlib.sha256(b"").hexdigest()
    texts = table[column]
    for r in range(table.num_rows):
        spans = _merged(packed[r])
        names = sorted(set(items[r]))
        n_hit.append(int((spans[:, 1] - spans[:, 0]).sum()))
        n_items.append(len(names))
        digest.append(hashlib.sha256(",".join(names).encode()).hexdigest() if names else empty)
        names_out.append(names)
        if not len(spans):
            clean.append(texts[r].as_py())
            spans_out.append([])
            continue
        first = w.bounds[r]
        a, b = w.starts[first + spans[:, 0]], w.ends[first + spans[:, 1] - 1]
        keep_from = np.r_[offsets[r], b]
        keep_to = np.r_[a, offsets[r + 1]]
        clean.append(b"".join(raw[i:j].tobytes() for i, j in zip(keep_from, keep_to)).decode("utf-8", "replace"))
        place = lambda at: len(raw[offsets[r] : at].tobytes().decode("utf-8", "replace"))
        spans_out.append([{"start": place(i), "end": place(j)} for i, j in zip(a, b)])
    columns = [table[k].combine_chunks() for k in keep] + [
        pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()),
        pa.array([h > 0 for h in n_hit], pa.bool_()), pa.array(names_out, pa.list_(pa.string())),
        pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(clean, pa.string()),
    ]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c for c in columns]
    return pa.record_batch(columns, names=[*keep, *_OUT_NAMES])


_OUT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, "
    "spans array<struct<start: long, end: long>>, clean_text string"
)
_OUT_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans", "clean_text"]


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark's items in blocks of bounded size."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        got = own.collect()
        yield [r["i"] for r in got], [r["t"] for r in got]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns of the documents, then ``n_words``, ``n_hit`` (words inside
    an occurrence), ``n_items``, ``items_sha256``, ``contaminated``, ``items``,
    ``spans`` (merged removal spans in code points, from the first hit word to
    the end of the last) and ``clean_text`` (the text without the spans; null
    where the text is null)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(Phrases(i, t, window)) for i, t in _blocks(benchmark, item, item_text, block_bytes)]
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"),
        F.lit(b"").cast("binary").alias("_spans"), F.array().cast("array<string>").alias("_items"),
    )
    kept_schema = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, docs.select(*[F.col(f'`{c}`') for c in keep]).schema))

    def pass_over(phrases, last: bool):
        def run(batches):
            for batch in batches:
                for part in W.chunks(pa.Table.from_batches([batch]), "_text", SHARD_BYTES):
                    found = _search(part, "_text", phrases.value)
                    if last:
                        yield _finish(found, "_text", names)
                    else:
                        yield from found.to_batches()

        return run

    for b in shared[:-1]:
        rows = rows.mapInArrow(W.lean(pass_over(b, False)), rows.schema)
    out = rows.mapInArrow(W.lean(pass_over(shared[-1], True)), kept_schema + _OUT)
    return out.toDF(*keep, *_OUT_NAMES)
