"""Reply parsing as column expressions: F3, F4, F5 and A8.

A reply is parsed with array functions on the JVM side (no Python UDF):
``split`` on the reference's separator class, ``array_position`` of the
quality, then the first later token that is either a quality name (stop) or
a number (value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.functions.text import NUMBER_WS_RE, col, first_token, py_float
from turnscore.schemas import DEFAULT_MISSING_SCORE, QUALITIES

SPLIT_RE = "[:;|,!? \\t\\n]"


def parse_single(reply: Column | str) -> Column:
    """the first whitespace token as a float; NULL when it is not one."""
    return py_float(first_token(reply))


def reply_words(reply: Column | str) -> Column:
    return F.split(F.lower(col(reply)), SPLIT_RE, -1)


def parse_multi(reply: Column | str, quality: str, names: Sequence[str] = QUALITIES,
                words: Column | None = None) -> Column:
    """from the first mention of ``quality`` scan to the first number,
    stopping at any quality name. NULL when not found. Pass ``words`` (the
    split reply, computed once per row) when parsing several qualities."""
    words = reply_words(reply) if words is None else words
    pos = F.array_position(words, quality)  # 1-based, 0 when absent
    name_arr = F.array(*[F.lit(n) for n in names])
    cands = F.filter(
        words,
        # words are lower-cased already; the pattern absorbs the whitespace
        # float() would strip, so no per-word trim or lower is needed
        lambda w, i: (i >= pos) & (F.array_contains(name_arr, w) | w.rlike(NUMBER_WS_RE)),
    )
    first = F.get(cands, 0)
    return F.when((pos > 0) & ~F.array_contains(name_arr, first), py_float(first))


def parse_value(reply: Column | str, quality: str, qualities: Sequence[str], words: Column | None = None) -> Column:
    """A prompt's raw value for one quality: single-number form first when the
    prompt has one quality, then the multi-quality form."""
    multi = parse_multi(reply, quality, words=words)
    if len(qualities) == 1:
        return F.coalesce(parse_single(reply), multi)
    return multi


def score_or_default(value: Column, default: float = DEFAULT_MISSING_SCORE, strict: bool = False,
                     message: str = "quality not found in reply") -> Column:
    """missing -> ``default`` (a default of 0 is respected); with
    ``strict`` a missing value raises instead."""
    if strict:
        return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)
    return F.coalesce(value, F.lit(float(default)))


def parse_replies(
    df: DataFrame, qualities: Sequence[str] = QUALITIES, reply: str = "reply",
    default: float = DEFAULT_MISSING_SCORE, strict: bool = False, keep: Sequence[str] = ("uid",),
) -> DataFrame:
    """F3-F5 long: ``(keep..., quality, score, parse_error, out_of_range)``;
    one row per reply and quality, fanned out with ``inline`` (no join)."""
    # split once per row; the per-quality scans read the materialised array
    base = df.select(*keep, F.col(reply).alias("_reply"), reply_words(reply).alias("_words"))
    vals = F.array(
        *[F.struct(F.lit(q).alias("quality"), parse_value("_reply", q, qualities, F.col("_words")).alias("raw"))
          for q in qualities]
    )
    x = base.select(*keep, F.inline(vals))
    return x.select(
        *keep,
        "quality",
        score_or_default(F.col("raw"), default, strict).alias("score"),
        F.col("raw").isNull().cast("int").alias("parse_error"),
        (F.col("raw").isNotNull() & ((F.col("raw") < 1) | (F.col("raw") > 5))).cast("int").alias("out_of_range"),
    )


def parse_error_totals(parsed: DataFrame, group: Sequence[str] = ("quality",)) -> DataFrame:
    """Failed parses per quality with the turn count."""
    return parsed.groupBy(*group).agg(
        F.sum("parse_error").cast("long").alias("n_errors"), F.count(F.lit(1)).alias("n_turns")
    )
