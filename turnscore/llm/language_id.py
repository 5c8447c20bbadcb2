"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of distinct byte n-grams (2 to 4 bytes,
hashed to ``DIMENSIONS`` places) present in both, over the geometric mean of
their own numbers. ``landmarks`` training texts span the Nyström feature space;
one kernel ridge regression per language, against the rest, is solved there.
A batch of texts is scored by matrix products: presence matrix times landmark
matrix times coefficients, the last two multiplied out beforehand, so that a
text costs one row gather per distinct n-gram.

Letters are folded to lower case; all other ASCII is one blank. A language's
score is its regression value cut to 0..1. As the values of a text add up to 1,
they compare languages only; whether a text is in any of them tells the share of
its 4-grams that a language's training texts hold (``known``), less what chance
would give in a table so full.

The model is fitted on a bounded sample: at most about ``PER_LANGUAGE`` labelled
texts per language, drawn by a hash of the text. Every text is scored whole.

Cases: a text that is null, empty or without letters is ``und`` with score 0;
ties go to the language that sorts first; rows without a label or text don't
train; with no training row every text is ``und``; repeated rows are scored
row by row."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscore.llm import words as W

ORDERS = (2, 3, 4)
DIMENSIONS = 1 << 16
#: Places of the longest n-grams for ``known``: far more than a language's texts hold, so chance hits stay rare.
KNOWN = 1 << 22
LANDMARKS = 256
PER_LANGUAGE = 400
RIDGE = 1e-2
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MULTIPLIER = np.uint32(2654435761)


def _codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams of a text's bytes, for n from 2 on."""
    s = _FOLD[data].astype(np.uint32)
    s = s[np.flatnonzero((s != 32) | (np.r_[np.uint32(0), s[:-1]] != 32))] if len(s) else s  # one blank for many
    if len(s):
        s = np.r_[np.uint32(32), s, np.uint32(32)]
    out, code = [], s
    for n in range(2, max(ORDERS) + 1):
        if len(s) < n:
            break
        code = code[:-1] * np.uint32(257) + s[n - 1 :]
        out.append(code)
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Places of all n-grams of a text's bytes (with repeats)."""
    out = [((code + np.uint32(n)) * _MULTIPLIER) >> np.uint32(16) for n, code in enumerate(_codes(data), 2) if n in ORDERS]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def long_grams(data: np.ndarray) -> np.ndarray:
    """Places of a text's longest n-grams in the ``KNOWN`` table (of the whole text, if it has fewer bytes)."""
    codes = _codes(data)
    return ((codes[-1] * _MULTIPLIER) >> np.uint32(32 - KNOWN.bit_length() + 1)).astype(np.int64) if codes else np.zeros(0, np.int64)


class Presence:
    """Distinct n-grams of one text after the other, without sorting."""

    def __init__(self):
        self.stamp = np.zeros(DIMENSIONS, np.int64)

    def of(self, data: np.ndarray) -> np.ndarray:
        g = grams(data)
        index = np.arange(len(g))
        self.stamp[g] = index  # the last occurrence stands for all
        return g[self.stamp[g] == index]


def has_letter(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold any letter."""
    low = data | 32
    if ((low >= 97) & (low <= 122)).any():
        return True
    if not (data >= 128).any():
        return False
    return any(unicodedata.category(c)[0] == "L" for c in set(data.tobytes().decode("utf-8", "replace")))


class Model:
    """Languages and the product of landmark matrix and coefficients
    (``DIMENSIONS`` x languages). ``held``: which long n-grams a language's
    training texts hold (packed bits, languages x ``KNOWN``); ``usual``: the
    known share that 99 of 100 training texts have in the others of their
    language."""

    def __init__(self, languages: list[str], weights: np.ndarray, offset: np.ndarray, held: np.ndarray | None = None, usual: float = 0.0):
        self.languages, self.weights, self.offset, self.held, self.usual = languages, weights, offset, held, usual
        self.chance = None if held is None else np.bitwise_count(held).sum(axis=1) / KNOWN

    def known(self, data: np.ndarray) -> float:
        """The share of a text's long n-grams that one language holds, at most,
        beyond what chance would hold."""
        g = long_grams(data)
        if not len(g):
            return 0.0
        share = ((self.held[:, g >> 3] >> (g & 7).astype(np.uint8)) & 1).mean(axis=1)
        return float(np.clip((share - self.chance) / (1 - np.minimum(self.chance, 0.999)), 0, 1).max())

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        return self.predict_known(texts, False)[:2]

    def predict_known(self, texts, known: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and the largest share of n-grams that a language holds (0 if not asked for)."""
        data, offsets = W.utf8(texts)
        n = len(offsets) - 1
        share = np.zeros(n)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n), share
        presence, found, sizes, rows = Presence(), [], [], []
        values = np.zeros((n, len(self.languages)))

        def flush() -> None:
            if not rows:
                return
            at = np.r_[0, np.cumsum(sizes)[:-1]]
            places = np.concatenate(found)
            sums = np.add.reduceat(self.weights[places], at, axis=0)
            values[rows] = sums / np.sqrt(np.array(sizes))[:, None] + self.offset
            found.clear(), sizes.clear(), rows.clear()

        letters = np.zeros(n, bool)
        for r in range(n):
            own = data[offsets[r] : offsets[r + 1]]
            letters[r] = has_letter(own)
            if letters[r]:
                g = presence.of(own)
                found.append(g), sizes.append(len(g)), rows.append(r)
                if known:
                    share[r] = self.known(own)
                if len(rows) >= 256:
                    flush()
        flush()
        best = values.argmax(axis=1)
        score = np.clip(values[np.arange(n), best], 0.0, 1.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)], np.where(letters, score, 0.0), share


def solve(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression, one against the rest."""
    languages = sorted(set(labels))
    data, offsets = W.utf8(pa.array(texts, pa.string()))
    presence = Presence()
    rows = [presence.of(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    used = [i for i, r in enumerate(rows) if len(r)]
    rows, labels = [rows[i] for i in used], [labels[i] for i in used]
    if not rows:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    by_language = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    share = max(1, landmarks // len(languages))
    chosen = [i for x in languages for i in by_language[x][:share]]
    marks = np.zeros((DIMENSIONS, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[rows[i], j] = 1 / np.sqrt(len(rows[i]))
    kernel = np.stack([marks[r].sum(axis=0) / np.sqrt(len(r)) for r in rows]).astype(np.float64)  # texts x landmarks
    inner = kernel[chosen]
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = kernel @ root
    target = np.array([[float(y == x) for x in languages] for y in labels])
    weight = np.array([1 / len(by_language[y]) for y in labels])[:, None]  # each language counts alike
    mean_x, mean_y = (features * weight).sum(0) / weight.sum(), (target * weight).sum(0) / weight.sum()
    fx = (features - mean_x) * np.sqrt(weight)
    fy = (target - mean_y) * np.sqrt(weight)
    gram = fx.T @ fx
    beta = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), fx.T @ fy)
    held, shares = np.zeros((len(languages), KNOWN // 8), np.uint8), []
    own = [long_grams(data[offsets[i] : offsets[i + 1]]) for i in used]
    for j, x in enumerate(languages):
        texts_with = np.zeros(KNOWN, np.int32)
        for i in by_language[x]:
            texts_with[np.unique(own[i])] += 1
        held[j] = np.packbits(texts_with > 0, bitorder="little")
        chance = (texts_with > 0).mean()
        shares += [float(((texts_with[own[i]] > 1).mean() - chance) / (1 - chance)) for i in by_language[x] if len(own[i])]
    return Model(languages, (marks @ (root @ beta)).astype(np.float32), mean_y - mean_x @ beta, held, float(np.quantile(shares, 0.01)))


def held_out(id_column: Column) -> Column:
    """Whether the crc32 of the id's digits is divisible by 5 (null: false)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fits on a sample of ``rows`` with a text and a label, drawn by text hash so
    that each language gives about ``per_language`` texts (all, if it has fewer)."""
    labelled = rows.select(F.col(text).alias("t"), F.col(label).alias("y")).where("t is not null and y is not null and t <> ''").withColumn(
        "h", F.xxhash64("t", F.lit("sample")))
    # a hot text counts, and is drawn, once
    counts = {r["y"]: r["n"] for r in labelled.select("y", "h").distinct().groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    steps = 1 << 30
    share = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, int(min(1.0, per_language / n) * steps))])
    place = F.pmod("h", F.lit(steps))
    drawn = labelled.where(place < share[F.col("y")]).groupBy("y", "h").agg(F.min("t").alias("t"))
    first = Window.partitionBy("y").orderBy(place, "h")
    sample = drawn.withColumn("i", F.row_number().over(first)).where(F.col("i") <= 2 * per_language).orderBy(place, "t", "y").collect()
    texts, labels = [r["t"] for r in sample], [r["y"] for r in sample]
    return solve(texts, labels, landmarks)


def classify(docs: DataFrame, model: Model, keep: list[str], text: str = "text", known: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (and ``known``, on request); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)])
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, rows.schema)] + ["_lang string", "_score double"] + ["_known double"] * known)
    at = kept[keep.index(text)] if text in keep else "_text"
    rows = rows if text in keep else docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        for batch in batches:
            for part in W.chunks(batch, at):
                lang, score, share = shared.value.predict_known(part.column(at), known)
                yield pa.record_batch(
                    [*[part.column(k) for k in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64()), *[pa.array(share, pa.float64())] * known],
                    names=[*kept, "_lang", "_score", *["_known"] * known],
                )

    return rows.mapInArrow(W.lean(run), schema).toDF(*keep, "lang_pred", "score", *["known"] * known)


def identify(docs: DataFrame, keep: list[str], text: str = "text", label: str = "lang", id_column: str = "doc_id", **options) -> DataFrame:
    """Fits on the rows that aren't held out and classifies all rows."""
    model = fit(docs.where(~held_out(F.col(id_column))), text, label, **options)
    return classify(docs, model, keep, text)
