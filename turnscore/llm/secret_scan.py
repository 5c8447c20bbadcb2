"""Secret scan with a linear-chain conditional random field.

Base patterns find key assignments, access keys and long hex runs. A CRF over
the tokens of the text adds what they miss: each token is tagged secret begin
(B), inside (I) or outside (O) from its shape, its neighbours, the signs around
it and features of the whole file; the best tagging is found by Viterbi.

The CRF learns from a bounded sample of texts (``SAMPLE``, drawn by text hash),
by forward-backward and AdaGrad over windows: around the base spans, elsewhere,
and around tokens planted at random places of the sample, random keys of several
make-ups as secrets and made-up identifiers, paths, dates, numbers and host
names as harmless neighbours of theirs. A planted key stands among words that no
base pattern knows, so its shape has to tell it: above all how often its
neighbouring characters change between digits, capitals and small letters. Each
window around a base span is taken a second time without its context features.
It claims random tokens of 20 characters and more that mix digits and letters;
short passwords and words are beyond it. Every text is scanned whole.

A tagging splits exactly where a token is outside by more than any gain from
transitions; only the short stretches between such tokens are decoded, all at
once. Spans of the CRF that touch a base span are dropped; base spans stay.

Positions are code points, ends exclusive. A null text is empty; empty texts
have no spans; without any text in the sample the CRF adds nothing;
repeated rows are scanned row by row; extra columns are ignored."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W

SAMPLE = 4000
WINDOW = 16
ROUNDS = 60
#: Windows taken away from the spans, at most.
ELSEWHERE = 1000
#: Texts of the sample that get planted tokens, at most.
PLANTED = 500
KINDS = ("assign", "access", "hex", "crf")

#: The base patterns and their least lengths.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-.", *range(128, 256)]] = True
SEPARATORS = bytes(np.flatnonzero(~_TOKEN).tolist())
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
#: Sign class of a byte next to a token.
_SIGN = np.full(256, 6, np.int64)
_SIGN[32], _SIGN[10], _SIGN[ord("=")], _SIGN[ord(":")], _SIGN[ord('"')], _SIGN[ord("'")] = 0, 1, 2, 3, 4, 4
#: Character class for shapes: other, digit, upper, lower, sign.
_CLASS = np.full(256, 0, np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_CLASS[list(b"+/_-.")] = 4

_HASH = 1 << 12
_BLOCKS = {"shape": 8 * 32, "mixed": 64, "turns": 8, "digits": 8 * 5, "hex": 8 * 2, "signs": 49, "switch": 8 * 4, "rate": 8 * 6, "file": 16, "own": _HASH, "before": _HASH, "after": _HASH}
_OFFSETS = dict(zip(_BLOCKS, np.cumsum([0, *_BLOCKS.values()])))
N_FEATURES = sum(_BLOCKS.values())


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, kind, start, end, value start, value end) in bytes of ``data``,
    leftmost and non-overlapping within a kind."""
    out = []
    n = len(offsets) - 1
    hexes = np.zeros(len(data) + 2, np.int8)
    hexes[1:-1] = _HEX[data]
    inner = offsets[1:-1]
    begin = (hexes[1:-1] == 1) & (hexes[:-2] == 0)
    end = (hexes[1:-1] == 1) & (hexes[2:] == 0)
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        begin[inner] = hexes[1:-1][inner] == 1
        end[inner - 1] = hexes[1:-1][inner - 1] == 1
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= LEAST_HEX
    for i, j in zip(a[long].tolist(), b[long].tolist()):
        out.append((int(np.searchsorted(offsets, i, side="right")) - 1, 2, i, j, i, j))
    signs = np.r_[0, np.cumsum((data == ord("=")) | (data == ord(":")))]
    raw = None
    for r in np.flatnonzero(signs[offsets[1:]] > signs[offsets[:-1]]).tolist():
        raw = data.tobytes() if raw is None else raw
        at = int(offsets[r])
        for m in ASSIGN.finditer(raw[at : int(offsets[r + 1])]):
            if len(m[2]) >= LEAST_ASSIGN:
                out.append((r, 0, at + m.start(), at + m.end(), at + m.start(2), at + m.end(2)))
    if len(data) > 3:
        keys = np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65))
        for r in sorted({int(x) for x in np.searchsorted(offsets, keys, side="right") - 1}):
            raw = data.tobytes() if raw is None else raw
            at = int(offsets[r])
            for m in ACCESS.finditer(raw[at : int(offsets[r + 1])]):
                if len(m[0]) >= LEAST_ACCESS:
                    out.append((r, 1, at + m.start(), at + m.end(), at + m.start(), at + m.end()))
    assert n >= 0
    return out


def features(data: np.ndarray, offsets: np.ndarray, w: W.Words) -> np.ndarray:
    """Feature numbers of every token (tokens x feature kinds)."""
    s, e, row = w.starts, w.ends, w.rows
    n = len(s)
    length = e - s
    size = np.minimum(7, np.searchsorted(np.array([2, 4, 8, 12, 16, 24, 40]), length, side="right"))
    kind = _CLASS[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.r_[np.int32(0), np.cumsum(mask, dtype=np.int32)]
        return total[e] - total[s]

    digits = count(kind == 1)
    has = [digits > 0] + [count(kind == k) > 0 for k in (2, 3, 4, 0)]
    shape = size * 32 + sum(h.astype(np.int64) << i for i, h in enumerate(has))
    share = np.minimum(4, (digits * 5) // np.maximum(length, 1))
    hexed = count(_HEX[data]) == length
    change = np.zeros(len(data), bool)
    if len(data) > 1:
        change[1:] = kind[1:] != kind[:-1]
    switches = count(change) - (change[s] if n else 0)
    switch = np.searchsorted(np.array([1, 3, 6]), switches, side="right")
    # changes between neighbouring digits, capitals and small letters, by the characters that could change
    plain = (kind >= 1) & (kind <= 3)
    turn = change.copy()
    turn[1:] &= plain[1:] & plain[:-1]
    turned = count(turn) - (turn[s] if n else 0)
    rate = np.searchsorted(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), turned / np.maximum(count(plain) - 1, 1), side="right")
    first, last = offsets[row], offsets[row + 1]
    left = np.where(s > first, _SIGN[data[np.maximum(s - 1, 0)]], 5)
    right = np.where(e < last, _SIGN[data[np.minimum(e, max(0, len(data) - 1))]], 5)
    bytes_of = np.maximum(np.diff(offsets), 1)
    total = np.r_[0, np.cumsum(kind == 1)]
    marks = np.isin(np.arange(256), list(b"={}<>;()_"))
    signs = np.r_[0, np.cumsum(marks[data])]
    file = np.searchsorted(np.array([0.002, 0.01, 0.05]), (total[offsets[1:]] - total[offsets[:-1]]) / bytes_of, side="right") * 4
    file = file + np.searchsorted(np.array([0.001, 0.005, 0.02]), (signs[offsets[1:]] - signs[offsets[:-1]]) / bytes_of, side="right")
    own = np.where(length < 16, (w.hashes[0] & W.U64(_HASH - 1)).astype(np.int64), 0)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n > 1:
        same = row[1:] == row[:-1]
        before[1:] = np.where(same, own[:-1], 1)
        after[:-1] = np.where(same, own[1:], 1)
    mixed = (shape & 31) * 2 + (length >= 12)
    turns = np.searchsorted(np.array([1, 3, 6]), switches, side="right") * 2 + (length >= 12)
    columns = {"shape": shape, "mixed": mixed, "turns": turns, "digits": size * 5 + share, "hex": size * 2 + hexed, "signs": left * 7 + right, "switch": size * 4 + switch,
               "rate": size * 6 + rate, "file": file[row], "own": own, "before": before, "after": after}
    return np.stack([(columns[k] + _OFFSETS[k]).astype(np.int32) for k in _BLOCKS], axis=1)


class CRF:
    """Weights of the features (x O, B, I) and transitions (from, to)."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, trained: bool = True):
        self.weights, self.transitions, self.trained = weights.astype(np.float32), transitions, trained

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), 3), np.float32)
        for k in range(f.shape[1]):
            out += self.weights[f[:, k]]
        return out

    def decode(self, emissions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best tags of the sequences ``bounds[i]:bounds[i+1]``."""
        n = len(emissions)
        tags = np.zeros(n, np.int8)
        slack = 2 * float(self.transitions.max() - self.transitions.min())
        open_ = emissions[:, 0] - emissions[:, 1:].max(axis=1) <= slack
        if not open_.any():
            return tags
        first = np.zeros(n, bool)
        first[bounds[:-1][bounds[:-1] < n]] = True
        start = np.flatnonzero(open_ & (first | np.r_[True, ~open_[:-1]]))
        final = np.zeros(n, bool)
        final[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        end = np.flatnonzero(open_ & (final | np.r_[~open_[1:], True])) + 1
        order = np.argsort(start - end, kind="stable")  # longest first
        start, end = start[order], end[order]
        length, t = end - start, self.transitions.astype(np.float64)
        score = emissions[start].astype(np.float64) + np.where(first[start][:, None], 0, t[0])  # the token before is outside
        back = []
        for step in range(1, int(length[0])):
            m = int(np.searchsorted(-length, -step, side="left"))  # sequences longer than step
            options = score[:m, :, None] + t[None]
            best = options.argmax(axis=1)
            back.append(best.astype(np.int8))
            score[:m] = np.take_along_axis(options, best[:, None], axis=1)[:, 0] + emissions[start[:m] + step]
        tag = (score + np.where(final[end - 1][:, None], 0, t[:, 0])).argmax(axis=1)
        tags[end - 1] = tag
        for step in range(len(back), 0, -1):
            m = len(back[step - 1])
            tag[:m] = back[step - 1][np.arange(m), tag[:m]]
            tags[start[:m] + step - 1] = tag[:m]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(f: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-3) -> CRF:
    """Maximum likelihood over sequences of equal length (padded; ``mask`` marks
    real tokens): f (n, T, kinds), y (n, T)."""
    n, T, kinds = f.shape
    w, t = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    gold = np.eye(3)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    for _ in range(rounds):
        e = w[f].sum(axis=2)
        e[~mask] = 0
        alpha, beta = np.zeros((n, T, 3)), np.zeros((n, T, 3))
        alpha[:, 0] = e[:, 0]
        for i in range(1, T):
            step = _logsum(alpha[:, i - 1, :, None] + t, 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        for i in range(T - 2, -1, -1):
            step = _logsum(t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i + 1])
        z = _logsum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad_t = pairs - joint[both].sum(axis=0) - decay * t
        grad_w = np.zeros_like(w)
        diff = (gold - p).reshape(-1, 3)
        flat = f.reshape(-1, kinds)
        for k in range(kinds):
            for tag in range(3):
                grad_w[:, tag] += np.bincount(flat[:, k], weights=diff[:, tag], minlength=N_FEATURES)
        grad_w -= decay * w
        gw += grad_w**2
        gt += grad_t**2
        w += rate * grad_w / np.sqrt(gw)
        t += rate * grad_t / np.sqrt(gt)
    return CRF(w, t)


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE62 = _DIGITS + _UPPER + _LOWER


def made_secret(r: random.Random) -> str:
    """A random key of one of several make-ups."""
    draw = lambda letters, a, b: "".join(r.choices(letters, k=r.randint(a, b)))
    return r.choice([
        lambda: draw(_BASE62, 20, 64), lambda: draw(_BASE62 + "+/", 24, 88), lambda: draw(_DIGITS + "ABCDEF", 24, 64), lambda: draw(_UPPER + "234567", 24, 40),
        lambda: draw(_DIGITS + _LOWER, 24, 48), lambda: draw(_LOWER, 2, 4) + r.choice("_-") + draw(_BASE62, 20, 44),
        lambda: ".".join(draw(_BASE62 + "-_", 12, 40) for _ in range(3)),
    ])()


def made_harmless(r: random.Random, words: list[str]) -> str:
    """A long or odd token that is no secret."""
    some = lambda n: [r.choice(words) for _ in range(n)]
    digits = lambda n: "".join(r.choices(_DIGITS, k=n))
    return r.choice([
        lambda: r.choice("-_./").join(some(r.randint(2, 6))), lambda: "".join(w.capitalize() for w in some(r.randint(2, 5))),
        lambda: "/".join([".".join(some(2)) + r.choice([".com", ".org", ".net"]), *some(r.randint(1, 3)), digits(r.randint(1, 6))]),
        lambda: "-".join([digits(4), digits(2), digits(2)]), lambda: digits(r.randint(5, 24)), lambda: "_".join(some(2)) + digits(r.randint(1, 4)) + ".html",
        lambda: "_".join(some(r.randint(2, 4))).upper(), lambda: ".".join(digits(r.randint(1, 3)) for _ in range(r.randint(2, 4))),
        lambda: f"{r.choice(words)}{digits(r.randint(1, 4))}.{'.'.join(some(2))}", lambda: r.choice(_UPPER) + digits(r.randint(1, 3)) + "-" + digits(r.randint(2, 8)),
    ])()


def planted(texts: list[str], most: int = PLANTED) -> list[tuple[str, list[tuple[int, int, bool]]]]:
    """Texts with made-up tokens at random places: byte spans and whether they are secrets."""
    out = []
    for i, text in enumerate(texts[:most]):
        r = random.Random(i)
        words = text.split(" ")
        plain = [w for w in (re.sub("[^a-z]", "", w) for w in words[:200]) if len(w) > 1] or ["data", "file"]
        at = sorted(r.sample(range(len(words) + 1), min(4, len(words) + 1)))
        pieces, spans, size, before = [], [], 0, 0
        for k, place in enumerate(at):
            secret = k % 2 == 0
            lead = r.choice(["", "", "", "=", ":", '"', "(", "key ", "value: "]) if secret else r.choice(["", "", "", '"', "(", "see "])
            token = made_secret(r) if secret else made_harmless(r, plain)
            head = " ".join([*words[before:place], lead])
            size += len(head.encode())
            spans.append((size, size + len(token), secret))
            size += len(token) + 1
            pieces.append(head + token)
            before = place
        pieces.append(" ".join(words[before:]))
        out.append((" ".join(pieces), spans))
    return out


def fit_texts(texts: list[str]) -> CRF:
    """Learns from the base spans of some texts and from tokens planted in them."""
    fs, ys, masks = [], [], []
    T, elsewhere = 2 * WINDOW + 1, 0
    context = [list(_BLOCKS).index(k) for k in ("signs", "before", "after")]

    def learn(part, extra: list[tuple[int, int, int, bool]], spread_too: bool) -> None:
        """``extra``: (row, start, end, secret) of planted tokens, in bytes of their row."""
        nonlocal elsewhere
        data, offsets = W.utf8(part)
        w = W.split(part, SEPARATORS)
        f = features(data, offsets, w)
        y = np.zeros(len(f), np.int64)
        based, centres = set(), []
        spans = [(int(offsets[r]) + a, int(offsets[r]) + b, secret) for r, a, b, secret in extra]
        base = [(a, b) for _, _, _, _, a, b in sorted(base_spans(data, offsets), key=lambda s: -s[1])]
        for a, b, secret in [*spans, *[(a, b, True) for a, b in base]]:
            i, j = int(np.searchsorted(w.ends, a, side="right")), int(np.searchsorted(w.starts, b, side="left"))
            if j > i:
                centres.append(i)
                if secret:
                    y[i:j] = 2
                    y[i] = 1
        for a, b in base:
            based.add(int(np.searchsorted(w.ends, a, side="right")))
        row = w.rows
        spread = np.zeros(0, np.int64)
        if spread_too:
            filled = np.flatnonzero(np.diff(w.bounds))
            spread = (w.bounds[filled] + (np.diff(w.bounds)[filled] * 0.37).astype(np.int64))[: max(0, ELSEWHERE - elsewhere)]
            elsewhere += len(spread)
        for c in [*centres, *spread.tolist()]:
            a, b = max(c - WINDOW, int(w.bounds[row[c]])), min(c + WINDOW + 1, int(w.bounds[row[c] + 1]))
            pad = T - (b - a)
            fs.append(np.pad(f[a:b], ((0, pad), (0, 0))))
            ys.append(np.pad(y[a:b], (0, pad)))
            masks.append(np.arange(T) < b - a)
            if c in based and spread_too:
                bare = fs[-1].copy()
                at = np.ix_((ys[-1] > 0) & masks[-1], context)
                bare[at] = np.array([_OFFSETS[list(_BLOCKS)[k]] for k in context])
                fs.append(bare), ys.append(ys[-1]), masks.append(masks[-1])

    for part in W.chunks(pa.table({"t": pa.array(texts, pa.string())}), "t"):
        learn(part["t"], [], True)
    more = planted([t for t in texts if t])
    for at in range(0, len(more), 200):
        some = more[at : at + 200]
        learn(pa.array([t for t, _ in some], pa.string()), [(r, a, b, secret) for r, (_, spans) in enumerate(some) for a, b, secret in spans], False)
    if not any((y > 0).any() for y in ys):
        return CRF(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), trained=False)
    return train(np.stack(fs), np.stack(ys), np.stack(masks))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> CRF:
    """Fits on about ``sample`` texts drawn by hash (twice as many at most)."""
    rows = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null and t <> ''")
    n = rows.count()
    steps = 1 << 30
    place = F.pmod(F.xxhash64("t", F.lit("secrets")), F.lit(steps))
    drawn = rows.where(place < int(min(1.0, sample / max(n, 1)) * steps)).distinct()
    return fit_texts(sorted(r["t"] for r in drawn.limit(2 * sample).collect()))


def scan(texts, crf: CRF) -> list[list[tuple[int, int, int]]]:
    """Per text: spans (start, end, kind) in code points, in order."""
    data, offsets = W.utf8(texts)
    found = [(r, k, a, b) for r, k, a, b, _, _ in base_spans(data, offsets)]
    if crf.trained and len(data):
        w = W.split(texts, SEPARATORS)
        if len(w.starts):
            tags = crf.decode(crf.emissions(features(data, offsets, w)), w.bounds)
            row = w.rows
            begins = np.flatnonzero((tags > 0) & ((tags == 1) | np.r_[True, tags[:-1] == 0] | np.r_[True, row[1:] != row[:-1]]))
            stop = np.flatnonzero((tags > 0) & np.r_[(tags[1:] != 2) | (row[1:] != row[:-1]), True])
            base = sorted((a, b) for _, _, a, b in found)
            starts = np.array([a for a, _ in base], np.int64)
            reach = np.maximum.accumulate(np.array([b for _, b in base], np.int64)) if base else np.zeros(0, np.int64)
            for i, j in zip(begins.tolist(), stop.tolist()):
                a, b = int(w.starts[i]), int(w.ends[j])
                k = int(np.searchsorted(starts, b, side="left")) - 1
                if k < 0 or reach[k] <= a:
                    found.append((int(row[i]), 3, a, b))
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if found else None
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for r, k, a, b in found:
        zero = points[offsets[r]]
        out[r].append((int(points[a] - zero), int(points[b] - zero), k))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, crf: CRF, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of the
    base spans as ``kind:start:end``, comma-joined), ``spans`` (all, likewise)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], F.col(f"`{text}`").alias("_text"))
    more = ["n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string"]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, rows.schema)] + [f"_{m}" for m in more])

    def run(batches):
        for batch in batches:
            for part in W.chunks(batch, "_text", 2 << 20):
                found = scan(part.column("_text"), shared.value)
                base = [[s for s in spans if s[2] < 3] for spans in found]
                yield pa.record_batch(
                    [*[part.column(k) for k in kept],
                     *[pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64()) for kind in range(3)],
                     pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string()),
                     pa.array([_listed(s) for s in found], pa.string())],
                    names=[*kept, *["_" + m.split(" ")[0] for m in more]],
                )

    return rows.mapInArrow(W.lean(run), schema).toDF(*keep, *[m.split(" ")[0] for m in more])
