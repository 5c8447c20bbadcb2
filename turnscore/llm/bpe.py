"""BPE encoding and decoding with forced-boundary splitting.

From the vocabulary alone follow byte pairs that no token holds inside. No
merge can ever join across such a pair, so it is a certain cut: the fragments
between cuts are encoded independently and their ids concatenated. A blank
makes such pairs with every neighbour, so whole texts first fall apart into
blank-separated words (found on the bytes of a batch at once), and a mark that
ends a word after a plain letter is cut off where no token joins the two; each
distinct word of a batch is normalised and pre-tokenised once, each of its
pieces is cut at the forced boundaries, and each distinct fragment is merged
once.
Fragments that end a piece carry the vocabulary's end-of-word mark, others
don't.

Work and memory follow the batch: caches live as long as a task, hold at most
``CACHE`` entries each and are emptied when full; of the words, only those that
a batch holds twice are kept for the next.

Cases: a null text is empty; an empty text has no tokens and decodes to the
empty text; special tokens written out in a text become their ids, as the
tokenizers library has it; repeated rows are encoded row by row."""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W

CACHE = 120_000
#: Bytes of text encoded at a time.
CHUNK = 1 << 20
#: Tokenizer files travel by broadcast up to this size.
MOST_FILE_BYTES = 64 << 20


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return out


class ForcedBoundaryBPE:
    """Encoder for a tokenizers file with a byte-level BPE model."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer, models

        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.normalizer, self.pre_tokenizer = self.library.normalizer, self.library.pre_tokenizer
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ending = models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None)
        self.inner = models.BPE(model["vocab"], merges)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.token = {i: t for t, i in model["vocab"].items()}
        self.token.update({a["id"]: a["content"] for a in spec.get("added_tokens", [])})
        byte = _byte_of_char()
        self.joins: set[str] = set()  # pairs that some token holds inside
        for t in model["vocab"]:
            body = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            self.joins.update(body[i : i + 2] for i in range(len(body) - 1))
        self.joins = {p for p in self.joins if p[0] in byte and p[1] in byte}
        self.plain = _splits_latin(spec)
        self.byte_level = {b: c for c, b in byte.items()}
        #: After a plain letter, a mark at the word's end is a piece of its own; it is cut off where no token joins them.
        self.cut_after = np.zeros((256, 256), bool)
        for letter in range(97, 123):
            for mark in range(33, 127):
                self.cut_after[letter, mark] = chr(letter) + chr(mark) not in self.joins
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        self.words: dict[bytes, tuple[bytes, bytes, int]] = {}

    def fragment_ids(self, fragment: str, last: bool) -> list[int]:
        key = (fragment, last)
        ids = self.fragments.get(key)
        if ids is None:
            ids = [t.id for t in (self.ending if last else self.inner).tokenize(fragment)]
            if len(self.fragments) >= CACHE:
                self.fragments.clear()
            self.fragments[key] = ids
        return ids

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token (in byte-level characters), cut at forced boundaries."""
        joins, ids, start = self.joins, [], 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in joins:
                ids += self.fragment_ids(piece[start:i], False)
                start = i
        return ids + self.fragment_ids(piece[start:], True)

    def word_ids(self, word: str) -> list[int]:
        if self.plain and _LATIN.fullmatch(word):
            pieces = self.plain.findall(word.lower())
            if not word.isascii():
                pieces = [p.encode().decode("latin-1").translate(self.byte_level) for p in pieces]
        else:
            normal = self.normalizer.normalize_str(word) if self.normalizer else word
            pieces = [p for p, _ in self.pre_tokenizer.pre_tokenize_str(normal)]
        if len(pieces) == 1:
            return self.piece_ids(pieces[0])
        return [i for p in pieces for i in self.piece_ids(p)]

    def word(self, raw: bytes, keep: bool) -> tuple[bytes, bytes, int]:
        """(ids as little-endian 32-bit integers, decoded text, number of ids) of a
        word; ``keep`` it for later batches."""
        found = self.words.get(raw)
        if found is None:
            word = raw.decode("utf-8", "replace")
            special = self.special_here and any(s in word for s in self.special)
            ids = self.library.encode(word, add_special_tokens=False).ids if special else self.word_ids(word)
            token = self.token
            found = (struct.pack(f"<{len(ids)}I", *ids), " ".join([token[i] for i in ids]).encode(), len(ids))
            if keep:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[raw] = found
        return found

    def units(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, bounds) of what is encoded on its own: words, in
        lower case where they are plain ASCII, less a closing mark, and those marks."""
        w = W.split(texts, n_hashes=0)
        data, starts, ends = w.data, w.starts, w.ends
        self.special_here = any(s.encode() in data.tobytes().lower() for s in self.special)
        if not self.plain or self.special_here:
            return data, starts, ends, w.bounds
        wide = np.r_[0, np.cumsum(data >= 128)]
        plain = wide[ends] == wide[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[plain]] += 1
        inside[ends[plain]] -= 1
        data = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, W.LOWER[data], data)
        long = ends - starts > 1
        cut = np.zeros(len(starts), bool)
        cut[long] = _MARK[data[ends[long] - 1]] & self.cut_after[data[ends[long] - 2], data[ends[long] - 1]]
        n = np.flatnonzero(cut)
        starts2 = np.insert(starts, n + 1, ends[n] - 1)
        ends2 = np.insert(np.where(cut, ends - 1, ends), n + 1, ends[n])
        return data, starts2, ends2, w.bounds + np.r_[0, np.cumsum(cut)][w.bounds]

    def encode_batch(self, texts) -> list[tuple[bytes, bytes, int]]:
        """For each text: ids, decoded text, number of ids."""
        data, starts, ends, bounds = self.units(texts)
        _, first, number = np.unique(W.span_hash(data, starts, ends, W.BASES[0]), return_index=True, return_inverse=True)
        raw = data.tobytes()
        often = (np.bincount(number, minlength=len(first)) > 1).tolist()
        known = [self.word(raw[a:b], k) for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), often)]
        ids, decoded = [k[0] for k in known], [k[1] for k in known]
        counts = np.array([k[2] for k in known], np.int64)
        total = np.concatenate([[0], np.cumsum(counts[number])]) if len(number) else np.zeros(1, np.int64)
        silent = bool((counts == 0).any())
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = number[a:b].tolist()
            text = b" ".join([decoded[i] for i in own if decoded[i]] if silent else [decoded[i] for i in own])
            out.append((b"".join([ids[i] for i in own]), text, int(total[b] - total[a])))
        return out


#: Marks that may close a word.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


#: Words of printable Latin characters: none of them composes with another, and
#: each has a lower case of its own.
_LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017f]+")


def _splits_latin(spec: dict):
    """For a file that folds case and splits by the usual word pattern: that
    pattern over lower-case Latin words, which spares them the library call."""
    try:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        fits = kinds == ["NFC", "Replace", "Lowercase"] and split["pattern"]["Regex"] == known and split["behavior"] == "Removed"
    except (KeyError, TypeError, IndexError):
        return None
    letters, numbers = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+") if fits else None


_ENCODERS: dict[str, ForcedBoundaryBPE] = {}


def encoder(content: str) -> ForcedBoundaryBPE:
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ForcedBoundaryBPE(content)
    return _ENCODERS[key]


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text", output: str = "ids") -> DataFrame:
    """``keep`` columns, ``n_tokens`` and, with ``output="ids"``, ``ids``
    (array<int>) and ``decoded``; with ``"digest"``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    if len(content) > MOST_FILE_BYTES:
        raise ValueError(f"tokenizer file of {len(content)} characters; at most {MOST_FILE_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], F.col(f"`{text}`").alias("_text"))
    more = {"ids": ["n_tokens long", "ids array<int>", "decoded string"],
            "digest": ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]}[output]
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, rows.schema)] + [f"_{m}" for m in more])

    def run(batches):
        bpe = encoder(shared.value)
        try:
            yield from encoded(bpe, batches)
        finally:  # workers are reused: an idle one would hold the encoder for other stages' whole time
            _ENCODERS.clear()

    def encoded(bpe, batches):
        for batch in batches:
            for part in W.chunks(batch, "_text", CHUNK):
                got = bpe.encode_batch(part.column("_text"))
                n = pa.array([g[2] for g in got], pa.int64())
                if output == "digest":
                    a = pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())
                    b = pa.array([hashlib.sha256(g[1]).hexdigest() for g in got], pa.string())
                else:
                    offsets = np.concatenate([[0], np.cumsum([g[2] for g in got])]).astype(np.int32)
                    flat = np.frombuffer(b"".join(g[0] for g in got), "<u4").astype(np.int32)
                    a = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                    b = pa.array([g[1].decode() for g in got], pa.string())
                yield pa.record_batch([*[part.column(k) for k in kept], n, a, b], names=[*kept, *["_" + m.split(" ")[0] for m in more]])

    return rows.mapInArrow(W.lean(run), schema).toDF(*keep, *[m.split(" ")[0] for m in more])
