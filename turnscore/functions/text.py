"""Text column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points beyond ASCII's blanks that Python's str.strip()
# and str.split() take as white space (separators, next line, wide blanks).
WIDE_SPACES = (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_BLANKS = " \\t\\n\\r\\x0b\\x0c" + "".join(f"\\x{{{c:x}}}" for c in WIDE_SPACES)
_WS = f"[{_BLANKS}]"

# A Python float() literal, lower-cased: digits with optional single
# underscores between them, optional fraction and exponent, or nan / inf /
# infinity, with an optional sign.
NUMBER_RE = (
    r"^[+-]?(((\d(_?\d)*)?\.\d(_?\d)*|\d(_?\d)*\.?)([eE][+-]?\d(_?\d)*)?|nan|inf|infinity)$"
)


# NUMBER_RE allowing the outer whitespace Python's float() ignores (for tokens
# that are already lower-cased)
NUMBER_WS_RE = NUMBER_RE.replace("^", f"^{_WS}*", 1).replace("$", f"{_WS}*$")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove outer whitespace, not only spaces."""
    return F.regexp_replace(col(c), f"^{_WS}+|{_WS}+$", "")


def py_float(token: Column | str) -> Column:
    """Python ``float(token)`` as a column: NULL where Python would raise.
    Outer whitespace is ignored and ``_`` digit separators are accepted, as
    in Python; Spark-only forms such as ``5d`` are rejected."""
    t = F.lower(trim_ws(token))
    return F.when(t.rlike(NUMBER_RE), F.regexp_replace(t, "_", "").try_cast("double"))


def first_token(c: Column | str) -> Column:
    """First whitespace-separated token (``s.split()[0]``), NULL if none."""
    tok = F.regexp_extract(col(c), f"^{_WS}*([^{_BLANKS}]+)", 1)
    return F.when(tok != "", tok)
