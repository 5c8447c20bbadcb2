"""Personal data by offset-preserving deobfuscation.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers in the text as it stands. Transducers then rewrite disguises, each
character of their output keeping the source range that it came from:

* homoglyphs: compatibility forms, letters of other scripts that look Latin,
  digits of other scripts, odd blanks and dashes become ASCII; invisible format
  characters vanish; ``O``, ``o``, ``I`` and ``l`` between digits are digits;
* at and dot: bracketed words (``[at]``, ``(dot)``) anywhere; a bare ``dot``
  between two words; a bare ``at`` only before a host that ends in a disguised
  dot and a known top-level name;
* spelled digits next to another digit (one blank, hyphen or dot apart), and
  ``plus`` before one.

The same patterns run on the rewritten text, and their spans are mapped back.
A span so found is added where something in it was rewritten, an address unless
a base span of its kind covers it, a number unless one touches it. Base spans
always stay. Only texts with a trace of a disguise pass the transducers; the
traces are necessary for any rewriting that can matter.

Positions are code points, ends exclusive. A null text is empty and has no
spans; repeated rows are scanned one by one; texts are scanned whole whatever
their length, in linear time; an empty table gives an empty result; extra
columns are ignored or kept where named in ``keep``."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Least and most digits of a card and of a phone number; largest part of an address.
CARD_DIGITS, PHONE_DIGITS, MOST_PART = (13, 19), (9, 15), 255


def _set(*members) -> np.ndarray:
    out = np.zeros(256, bool)
    for m in members:
        out[list(m.encode()) if isinstance(m, str) else list(m)] = True
    return out


_DIGIT = _set(range(48, 58))
_LABEL = _set(range(48, 58), range(65, 91), range(97, 123), "-")
_LOCAL = _LABEL | _set("._%+")
_CARD_GAP = _set(" -")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(rb"[\x20().0-9-]*")

# ---------------------------------------------------------------- patterns


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask over the bytes, none across rows."""
    m = np.zeros(len(mask) + 2, bool)
    m[1:-1] = mask
    begin, end = m[1:-1] & ~m[:-2], m[1:-1] & ~m[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(mask))]
    begin[cut] = mask[cut]
    end[cut - 1] = mask[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def _local_start(data: np.ndarray, first: int, at: int) -> int:
    """Where the run of local-part bytes that ends before ``at`` begins."""
    step, low = 64, at
    while low > first:
        b = max(first, low - step)
        bad = np.flatnonzero(~_LOCAL[data[b:low]])
        if len(bad):
            return b + int(bad[-1]) + 1
        low, step = b, step * 2
    return low


def _emails(data, offsets, raw):
    at = np.flatnonzero(data == 64)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_LOCAL[data[at - 1]] & _LABEL[data[at + 1]]]
    done = 0
    for a, r in zip(at.tolist(), _row_of(offsets, at).tolist()):
        start = max(_local_start(data, int(offsets[r]), a), done)
        found = _DOMAIN.match(raw(), a + 1, int(offsets[r + 1])) if start < a else None
        if found:
            done = found.end()
            yield r, EMAIL, start, done


def _chains(s: np.ndarray, e: np.ndarray, row: np.ndarray, data: np.ndarray, gap: np.ndarray):
    """(first, behind the last) run of each chain of digit runs that one byte of ``gap`` joins."""
    joined = np.zeros(len(s), bool)
    joined[1:] = (s[1:] - e[:-1] == 1) & (row[1:] == row[:-1])
    joined[1:][joined[1:]] = gap[data[e[:-1][joined[1:]]]]
    first = np.flatnonzero(~joined)
    return first, np.r_[first[1:], len(s)]


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _numbers(data, offsets, raw):
    s, e = _runs(_DIGIT[data], offsets)
    if not len(s):
        return
    row = _row_of(offsets, s)
    first, behind = _chains(s, e, row, data, _set("."))
    for i, j in zip(first[behind - first >= 4].tolist(), behind[behind - first >= 4].tolist()):
        for k in range(i, j - 3, 4):
            parts = [raw()[s[x] : e[x]].lstrip(b"0") for x in range(k, k + 4)]
            if all(len(p) <= 3 and int(p or b"0") <= MOST_PART for p in parts):
                yield int(row[k]), IP, int(s[k]), int(e[k + 3])
    total = np.r_[0, np.cumsum(e - s)]
    first, behind = _chains(s, e, row, data, _CARD_GAP)
    n = total[behind] - total[first]
    fits = (n >= CARD_DIGITS[0]) & (n <= CARD_DIGITS[1])
    for i, j in zip(first[fits].tolist(), behind[fits].tolist()):
        if _luhn(b"".join(raw()[s[x] : e[x]] for x in range(i, j))):
            yield int(row[i]), CARD, int(s[i]), int(e[j - 1])
    plus = np.flatnonzero(data[:-1] == 43)
    plus = plus[_DIGIT[data[plus + 1]]]
    rows = _row_of(offsets, plus)
    plus, rows = plus[plus + 1 < offsets[rows + 1]], rows[plus + 1 < offsets[rows + 1]]
    for p, r in zip(plus.tolist(), rows.tolist()):
        stop = _NUMBER.match(raw(), p + 1, int(offsets[r + 1])).end()
        last = int(np.searchsorted(e, stop, side="right")) - 1
        n = int(total[last + 1] - total[np.searchsorted(s, p + 1)])
        if e[last] > p + 3 and PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]:
            yield r, PHONE, p, int(e[last])


def identifiers(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, kind, start, end) in bytes, leftmost and non-overlapping within a kind."""
    if not len(data):
        return []
    kept: list[bytes] = []

    def raw() -> bytes:
        if not kept:
            kept.append(data.tobytes())
        return kept[0]

    return [*_emails(data, offsets, raw), *_numbers(data, offsets, raw)]


def in_points(data: np.ndarray, offsets: np.ndarray, spans) -> list[list[tuple[int, int, int]]]:
    """Per row (kind, start, end) in code points, in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if spans:
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        for r, kind, a, b in spans:
            zero = points[offsets[r]]
            out[r].append((kind, int(points[a] - zero), int(points[b] - zero)))
        for row in out:
            row.sort()
    return out


# ---------------------------------------------------------------- transducers

#: Letters of other scripts and the Latin ones that they look like.
LOOKALIKES = dict(zip(
    "аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅοανρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɑ。−",
    "aeopcyxijshdqwvABEKMHOPCTYXIJSoavpikABEZHIKMNOPTYXiga.-",
))
#: Names of the digits, in four languages.
SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
}
#: Words that stand for signs, and top-level names that end a spoken address.
AT_WORDS, DOT_WORDS = "at ät arroba arobase".split(), "dot punkt punto point".split()
TOP_LEVEL = "com org net edu gov info biz io dev app co uk de fr es eu ch nl ca au".split()

_ANY = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
_AT = re.compile(rf" {{0,2}}[\[({{<] ?(?:{_ANY(AT_WORDS)}) ?[\])}}>] {{0,2}}", re.I)
_DOT = re.compile(rf" {{0,2}}[\[({{<] ?(?:{_ANY(DOT_WORDS)}) ?[\])}}>] {{0,2}}|(?<=[^\W_]) dot (?=[^\W_])", re.I)
_SPOKEN = re.compile(
    rf"(?<=[A-Za-z0-9._%+-]) at (?=[A-Za-z0-9-]+(?:(?:\.| dot )[A-Za-z0-9-]+)* dot (?:{_ANY(TOP_LEVEL)})(?![A-Za-z0-9-]))", re.I)
_WORD = rf"(?<![^\W_])(?:{_ANY(SPELLED)})(?![^\W_])"
_RUN = re.compile(rf"(?:(?<![^\W_])plus )?{_WORD}(?:[ .-](?:{_WORD}|[0-9]))*|(?<![^\W_])plus (?=[0-9])", re.I)
_PIECE = re.compile(rf"(?P<word>{_WORD})|(?P<plus>plus )|(?P<other>.)", re.I | re.S)
_BETWEEN = re.compile(r"(?<=[0-9])[OoIl]+(?=[0-9])")
_DIGIT_LIKE = {"O": "0", "o": "0", "I": "1", "l": "1"}

def _either_case(words: list[str]) -> bytes:
    """Alternatives over the bytes of text whose ASCII letters are lower-cased."""
    out = _ANY(words).encode()
    for c in "äéü":
        out = out.replace(c.encode(), b"(?:" + c.encode() + b"|" + c.upper().encode() + b")")
    return out


#: Bracketed words, a bare dot, number words that touch another or a digit, and plus before one.
_TRACE = re.compile(
    rb"[\[({<] ?(?:%(signs)s) ?[\])}>]| dot |(?:%(names)s)[ .-](?:%(names)s|[0-9])|[0-9][ .-](?:%(names)s)|plus (?:%(names)s|[0-9])"
    % {b"signs": _either_case(AT_WORDS + DOT_WORDS), b"names": _either_case(list(SPELLED))}
)
_GONE = 0xFFFFFFFF


@cache
def homoglyphs() -> np.ndarray:
    """What each code point below U+20000 becomes (``_GONE``: nothing)."""
    table = np.arange(0x20000, dtype=np.uint32)
    for c in range(0x80, 0x20000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Cf":
            table[c] = _GONE
        elif kind == "Zs":
            table[c] = 32
        elif kind == "Pd":
            table[c] = 45
        elif kind == "Nd":
            table[c] = 48 + unicodedata.decimal(ch)
        elif kind != "Cs" and not unicodedata.decomposition(ch).startswith(("<super>", "<sub>")):
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and " " < plain <= "~":
                table[c] = ord(plain)
    for ch, plain in LOOKALIKES.items():
        table[ord(ch)] = ord(plain)
    return table


@cache
def _odd_bytes() -> np.ndarray:
    """Whether a UTF-8 lead byte (and the next byte, of two-byte forms) may open a homoglyph."""
    out = np.zeros((256, 256), bool)
    for c in np.flatnonzero(homoglyphs() != np.arange(0x20000)).tolist():
        if not 0xD800 <= c < 0xE000:
            b = chr(c).encode()
            out[b[0], b[1]] = True
    return out


class Tape:
    """A text with the source range ``low[i]:high[i]`` of each of its characters."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        table = homoglyphs()
        new = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points)
        self.low = np.flatnonzero(new != _GONE)
        self.high = self.low + 1
        self.text = new[self.low].astype("<u4").tobytes().decode("utf-32-le")
        self.changed = (new != points)[self.low]

    def replace(self, cuts: list[tuple[int, int, str]]) -> None:
        """Puts one character, or none, for each (start, end, character); cuts in order."""
        if not cuts:
            return
        text, low, high, changed, at = [], [], [], [], 0
        for a, b, char in cuts:
            text += [self.text[at:a], char]
            low.append(self.low[at:a]), high.append(self.high[at:a]), changed.append(self.changed[at:a])
            if char:
                low.append(self.low[a : a + 1]), high.append(self.high[b - 1 : b]), changed.append(np.ones(1, bool))
            at = b
        text.append(self.text[at:])
        low.append(self.low[at:]), high.append(self.high[at:]), changed.append(self.changed[at:])
        self.text = "".join(text)
        self.low, self.high, self.changed = np.concatenate(low), np.concatenate(high), np.concatenate(changed)


def _signs(tape: Tape) -> None:
    spoken = [(m.start(), m.end(), "@") for m in _SPOKEN.finditer(tape.text)]
    marked = [(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)]
    cuts, at = [], 0
    for a, b, char in sorted(spoken + marked):
        if a >= at:
            cuts.append((a, b, char))
            at = b
    tape.replace(cuts)


def _digits(tape: Tape) -> None:
    tape.replace([(i, i + 1, _DIGIT_LIKE[tape.text[i]]) for m in _BETWEEN.finditer(tape.text) for i in range(m.start(), m.end())])
    cuts = []
    for m in _RUN.finditer(tape.text):
        before = tape.text[max(0, m.start() - 2) : m.start()]
        pieces = list(_PIECE.finditer(m[0]))
        words = sum(p.lastgroup == "word" for p in pieces)
        digits = any(p.lastgroup == "other" and p[0].isdigit() for p in pieces)
        near = len(before) == 2 and before[0] in "0123456789" and before[1] in " .-"
        plus = bool(pieces) and pieces[0].lastgroup == "plus"
        if words and not (words > 1 or digits or near or plus):
            continue
        for i, p in enumerate(pieces):
            a, b = m.start() + p.start(), m.start() + p.end()
            if p.lastgroup == "word":
                cuts.append((a, b, SPELLED[p[0].lower()]))
            elif p.lastgroup == "plus":
                cuts.append((a, b, "+"))
            elif p[0] in " -" and pieces[i - 1].lastgroup == "word" and pieces[i + 1].lastgroup == "word":
                cuts.append((a, b, ""))
    tape.replace(cuts)


def deobfuscate(text: str) -> Tape:
    """The text after all transducers, with its way back."""
    tape = Tape(text)
    _signs(tape)
    _digits(tape)
    return tape


def traces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the rows that may hold a disguise."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = [np.zeros(0, np.int64)]
    high = np.flatnonzero(data[:-1] >= 0xC2)
    at.append(high[_odd_bytes()[data[high], data[high + 1]]])
    like = np.flatnonzero(_set("OoIl")[data[1:]] & _DIGIT[data[:-1]])
    at.append(like[_set("OoIl0123456789")[data[np.minimum(like + 2, len(data) - 1)]]])
    lower = W.LOWER[data].tobytes()
    at.append(np.array([m.start() for m in _TRACE.finditer(lower)], np.int64))
    return np.unique(_row_of(offsets, np.concatenate(at)))


def _added(own: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the mapped spans that base spans leave."""
    out = []
    for kind, a, b in own:
        same = [(x, y) for k, x, y in base if k == kind]
        if kind == EMAIL:
            known = any(x <= a and b <= y for x, y in same)
        else:
            known = any(x < b and a < y for x, y in same)
        if not known:
            out.append((kind, a, b))
    return out


def scan(texts: pa.Array) -> tuple[list, list]:
    """Per text its base spans and all spans, (kind, start, end) by kind, then start."""
    data, offsets = W.utf8(texts)
    base = in_points(data, offsets, identifiers(data, offsets))
    spans = list(base)
    rows = traces(data, offsets)
    for part in np.array_split(rows, max(1, len(rows) // 256)):
        if not len(part):
            continue
        tapes = [deobfuscate(data[offsets[r] : offsets[r + 1]].tobytes().decode()) for r in part.tolist()]
        rewritten, bounds = W.utf8(pa.array([t.text for t in tapes], pa.large_string()))
        for r, tape, found in zip(part.tolist(), tapes, in_points(rewritten, bounds, identifiers(rewritten, bounds))):
            own = [(k, int(tape.low[a]), int(tape.high[b - 1])) for k, a, b in found if tape.changed[a:b].any() or tape.high[b - 1] - tape.low[a] != b - a]
            more = _added(own, base[r])
            if more:
                spans[r] = sorted(base[r] + more)
    return base, spans


# ---------------------------------------------------------------- DataFrames

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _column(found: list) -> pa.Array:
    """A list of span lists as an Arrow column."""
    flat = [s for row in found for s in row]
    structs = pa.StructArray.from_arrays(
        [pa.array([KINDS[k] for k, _, _ in flat], pa.string()), pa.array([a for _, a, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())],
        fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)), structs).cast(_SPANS)


def find_personal(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``base`` (spans of the base patterns) and ``found`` (all
    spans), both by kind and start."""
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(kept, rows.schema)] + [f"_base {SPANS}", f"_found {SPANS}"])

    def run(batches):
        for batch in batches:
            for part in W.chunks(batch, "_text", 2 << 20):
                base, spans = scan(part.column("_text"))
                yield pa.record_batch([*[part.column(k) for k in kept], _column(base), _column(spans)], names=[*kept, "_base", "_found"])

    return rows.mapInArrow(W.lean(run), schema).toDF(*keep, "base", "found")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by the kind of the
    first span there, in angle brackets."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state, s):
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))),
                         F.when(s["start"] >= state["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        return F.struct(piece.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    return F.aggregate(by_start, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
