"""Dialogue rows and history: P1-P6, W1, W2, A15, F6.

History is a window partitioned by dialogue and ordered by turn number, never
file order: one shuffle on the dialogue key, then every turn sees the
turns before it. Output is quadratic in dialogue length by definition; the
window buffer spills, and an optional ``max_history`` keeps only the last k
turns (off by default, so contexts stay whole).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscore.functions.text import col, trim_ws

LANG_COLUMNS = {
    "en": ("context", "response"),
    "zh": ("context_zh", "response_zh"),
    "es": ("context_es", "response_es"),
    "par": ("context_pa", "response_pa"),
}


def drop_first_turns(df: DataFrame, uid: str = "uid", suffix: str = "000") -> DataFrame:
    """Drop turns whose UID ends with ``suffix`` (``000`` at load,
    ``0000`` for submissions). NULL UIDs are kept, as pandas' ``na=False``."""
    return df.where(~F.coalesce(F.col(uid).endswith(suffix), F.lit(False)))


def parse_uid(uid: Column | str = "uid", prefix: str = "TEST") -> list[Column]:
    """``TEST-<dialogue>-<turn>`` into parts; ``prefix_ok`` is false (not
    an exception) for a wrong prefix or part count, so bad rows can be routed
    to a reject table."""
    u = col(uid)
    parts = F.split(u, "-", -1)
    return [
        F.get(parts, 0).alias("uid_prefix"),
        F.get(parts, 1).alias("uid_dialogue"),
        F.get(parts, 2).alias("uid_turn"),
        F.substring_index(u, "-", -1).alias("turn_last"),
        ((F.get(parts, 0) == prefix) & (F.size(parts) == 3)).alias("prefix_ok"),
    ]


def language_variant(df: DataFrame, eval_type: str, keep: tuple[str, ...] = ("dialogue_id",)) -> DataFrame:
    """context/response of one variant (en, zh, es, par)."""
    if eval_type not in LANG_COLUMNS:
        raise ValueError(f"unknown language variant {eval_type!r}; known: {', '.join(LANG_COLUMNS)}")
    c, r = LANG_COLUMNS[eval_type]
    return df.select(*keep, F.lit(eval_type).alias("lang"), F.col(c).alias("context"), F.col(r).alias("response"))


def melt_variants(df: DataFrame, keep: tuple[str, ...] = ("dialogue_id",)) -> DataFrame:
    """P3 long form: one row per (row, variant) via ``inline`` (no join)."""
    arr = F.array(
        *[
            F.struct(F.lit(k).alias("lang"), F.col(c).alias("context"), F.col(r).alias("response"))
            for k, (c, r) in LANG_COLUMNS.items()
        ]
    )
    return df.select(*keep, F.inline(arr))


def empty_response(c: Column | str = "response", text: str = "no response") -> Column:
    """Exactly-empty response -> ``no response`` (before trimming)."""
    c = col(c)
    return F.when(c == "", F.lit(text)).otherwise(c)


def speaker_tags(ctx: Column | str) -> Column:
    """Trim, split on newline, tag lines alternately from the end (last
    line ``A: ``, the one before ``B: ``), rejoin. An empty context gives
    ``A: ``."""
    lines = F.reverse(F.split(trim_ws(ctx), "\n", -1))
    tagged = F.transform(lines, lambda x, i: F.concat(F.when(i % 2 == 0, "A: ").otherwise("B: "), x))
    return F.array_join(F.reverse(tagged), "\n")


def prepare_pairs(df: DataFrame, insert_speaker: bool = False, context: str = "context",
                  response: str = "response") -> DataFrame:
    """P4 + P5 (+ P6): empty response, trimming, speaker roles."""
    r = trim_ws(empty_response(response))
    if insert_speaker:
        return df.withColumn(context, speaker_tags(context)).withColumn(response, F.concat(F.lit("B: "), r))
    return df.withColumn(context, trim_ws(context)).withColumn(response, r)


def _keys(k: str | Sequence[str]) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def dialogue_context(
    df: DataFrame,
    dialogue: str | Sequence[str] = "dialogue_id",
    turn: str = "turn_id",
    text: str = "text",
    insert_speaker: bool = False,
    max_history: int | None = None,
    out: str = "context",
    block_size: int | None = 256,
    trim: bool = True,
) -> DataFrame:
    """Context of a turn = all earlier (kept) turns of its dialogue,
    trimmed, joined by newline; empty for the first kept turn. ``dialogue``
    may be several key columns (W2 uses dialogue and segment).

    With ``block_size`` (default) a dialogue is cut into blocks, so one that
    holds a large share of all rows is spread over many tasks; the result is
    identical to the plain window (``block_size=None``).

    Whole history: blocks of turn numbers. One aggregate by ``(dialogue,
    block)`` gathers a block's turns in order (the only shuffle of whole rows);
    the texts of all earlier blocks come from a window over the dialogue's
    blocks, one joined text per block; each turn then takes the texts before it
    from its block's array. The contexts are quadratic in the dialogue's length
    by definition.

    ``max_history`` (the last k turns): turns are numbered by a segmented scan
    (:func:`ordinals`) and cut into blocks of consecutive numbers, at least k
    long; a block also gets the last k texts of the one before, and a window
    inside the block does the rest. No task sees more than two blocks' texts,
    however long the dialogue is."""
    keys = _keys(dialogue)
    t = trim_ws(text) if trim else F.col(text)
    if block_size is None:
        lo = Window.unboundedPreceding if max_history is None else -max_history
        w = Window.partitionBy(*keys).orderBy(turn).rowsBetween(lo, -1)
        ctx = F.array_join(F.collect_list(t).over(w), "\n")
        return df.withColumn(out, speaker_tags(ctx) if insert_speaker else ctx)
    columns = [c for c in df.columns if c != out]
    rest = [c for c in columns if c not in keys]
    if max_history is not None:
        size = max(block_size, max_history)
        numbered = ordinals(df, keys, turn, "_ord", block_size)
        whole = F.struct(*rest)
        tail = F.col("_ord") % size >= size - max_history
        # for each turn its own row and, near the end of a block, its text for the next one
        spots = F.array(F.struct(F.floor(F.col("_ord") / size).alias("_blk"), F.lit(True).alias("_own")))
        later = F.array(F.struct((F.floor(F.col("_ord") / size) + 1).alias("_blk"), F.lit(False).alias("_own")))
        x = numbered.select(*keys, "_ord", t.alias("_t"), whole.alias("_row"), F.inline(F.when(tail, F.concat(spots, later)).otherwise(spots)))
        x = x.withColumn("_row", F.when(F.col("_own"), F.col("_row")))
        w = Window.partitionBy(*keys, "_blk").orderBy("_ord").rowsBetween(-max_history, -1)
        ctx = F.array_join("_texts", "\n")
        x = x.withColumn("_texts", F.collect_list("_t").over(w)).where("_own")
        return x.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in columns], (speaker_tags(ctx) if insert_speaker else ctx).alias(out))
    x = df.select(*keys, F.floor(F.col(turn) / F.lit(block_size)).alias("_blk"),
                  F.struct(F.col(turn).alias("_k"), t.alias("_t"), F.struct(*rest).alias("_row")).alias("_s"))
    blocks = x.groupBy(*keys, "_blk").agg(_in_order(F.collect_list("_s"), x.schema["_s"].dataType).alias("_ss"))
    blocks = blocks.withColumn("_tt", F.transform("_ss", lambda s: s["_t"]))
    texts = F.filter("_tt", lambda v: v.isNotNull())
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # one text per block, none for a block without any; a null block number orders first
    whole = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    blocks = blocks.withColumn("_pre", F.collect_list(whole).over(earlier))
    y = blocks.select(*keys, "_tt", "_pre", F.posexplode("_ss").alias("_i", "_s"))
    own = F.filter(F.slice("_tt", 1, F.col("_i")), lambda v: v.isNotNull())
    ctx = F.array_join(F.concat("_pre", own), "\n")
    if insert_speaker:
        ctx = speaker_tags(ctx)
    return y.select(*[F.col(c) if c in keys else F.col("_s._row")[c].alias(c) for c in columns], ctx.alias(out))


def _in_order(turns: Column, of: T.StructType) -> Column:
    """A list of structs by their first field; with the structs' own order where
    their types have one (compared natively), else by a comparator."""

    def ordered(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(ordered(f.dataType) for f in t.fields)
        return ordered(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))

    if ordered(of):
        return F.sort_array(turns)
    return F.array_sort(turns, lambda a, b: F.when(a[of.names[0]] < b[of.names[0]], -1).when(a[of.names[0]] > b[of.names[0]], 1).otherwise(0))


def _scan(df: DataFrame, keys: Sequence[str], turn: str, count: Column, out: str, block_size: int) -> DataFrame:
    """A segmented scan: ``count`` summed over the turns up to each one of its
    dialogue. Sums inside blocks of turn numbers, a prefix over a dialogue's
    blocks (one row each), and a join of the two; no task sees a dialogue's rows."""
    x = df.withColumn("_blk", F.floor(F.col(turn) / F.lit(block_size)))
    inside = Window.partitionBy(*keys, "_blk").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum(count).over(inside))
    totals = x.groupBy(*keys, "_blk").agg(F.sum(count).alias("_bt"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_p{i}" for i, c in enumerate([*keys, "_blk"])}
    prefix = totals.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("_bt").over(earlier), F.lit(0)).alias("_pre"))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return x.join(prefix, same, "left").select(*[c for c in df.columns if c != out], (F.coalesce("_pre", F.lit(0)) + F.col("_in")).cast("long").alias(out))


def ordinals(df: DataFrame, dialogue: str | Sequence[str], turn: str, out: str, block_size: int = 256) -> DataFrame:
    """The number (from 0) of each turn in its dialogue."""
    counted = _scan(df, _keys(dialogue), turn, F.lit(1), out, block_size)
    return counted.withColumn(out, F.col(out) - 1)


def running_count(df: DataFrame, dialogue: str, turn: str, flag: str, out: str,
                  block_size: int | None = 256) -> DataFrame:
    """Number of ``flag`` rows at or before each turn of its dialogue, by the
    same segmented scan, so a hot dialogue is not one task."""
    f = F.col(flag).cast("int")
    if block_size is None:
        w = Window.partitionBy(dialogue).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(f).over(w))
    return _scan(df, [dialogue], turn, f, out, block_size)


def segment_context(
    df: DataFrame,
    dialogue: str = "dialogue_id",
    turn: str = "turn_id",
    turn_label: str = "turn_last",
    text: str = "response",
    strict: bool = False,
    block_size: int | None = 256,
) -> DataFrame:
    """A turn whose id ends in ``0`` (``strict``: equals 0) starts a new
    segment and resets the history; later turns see all responses since the
    reset (raw, not trimmed). Adds ``is_first``, ``segment`` and ``context``.
    Both the segment numbering and the history are blocked against hot
    dialogues."""
    first = (F.col(turn) == 0) if strict else F.col(turn_label).endswith("0")
    with_seg = running_count(df.withColumn("is_first", first), dialogue, turn, "is_first", "segment", block_size)
    return dialogue_context(with_seg, [dialogue, "segment"], turn, text, block_size=block_size, trim=False)


def two_view(p: Column, o: Column, original_present: Column) -> Column:
    """Mean of the paraphrase and original rating; paraphrase alone
    when the original row has no ratings."""
    return F.when(original_present, (p + o) / 2).otherwise(p)


def rehearsal_rows(df: DataFrame, variant: str = "constant", strict: bool = False) -> DataFrame:
    """E5 core, A15 + F6 over W2: rehearsal rows from paraphrase/original
    ratings. ``variant`` decides the first turn of a segment: ``constant``
    sets relevance 5.0, ``copy`` sets relevance to the two-view mean of
    appropriateness, ``omit`` drops the row (after the history is built, so
    it still enters later contexts)."""
    return rehearsal_variants(df, (variant,), strict).drop("variant")


def rehearsal_variants(df: DataFrame, variants=("constant", "copy", "omit"), strict: bool = False) -> DataFrame:
    """F6 for several variants in one pass: the history and two-view ratings
    are computed once, then every row fans out over the variants (``explode``
    of a literal list, no join)."""
    for v in variants:
        if v not in ("constant", "copy", "omit"):
            raise ValueError(f"unknown rehearsal variant {v!r}")
    parts = F.split("id", "-", -1)
    x = df.withColumn("dialogue_key", F.get(parts, 1)).withColumn(
        "turn_id", F.substring_index("id", "-", -1).cast("long")
    ).withColumn("turn_last", F.substring_index("id", "-", -1))
    x = segment_context(x, dialogue="dialogue_key", turn="turn_id", turn_label="turn_last", strict=strict)
    has_o = F.col("o_cont").isNotNull()
    tv = {k: two_view(F.col(f"p_{k}"), F.col(f"o_{k}"), has_o) for k in ("appr", "cont", "gram", "rel")}
    first = F.col("is_first")
    rel = (
        F.when(first & (F.col("variant") == "constant"), F.lit(5.0))
        .when(first & (F.col("variant") == "copy"), (F.col("p_appr") + F.col("o_appr")) / 2)
        .otherwise(tv["rel"])
    )
    x = x.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    out = x.where(~(first & (F.col("variant") == "omit"))).select(
        "variant",
        F.col("id").alias("dialogue_id"),
        F.col("sid").alias("model"),
        F.when(first, F.lit("")).otherwise(F.col("context")).alias("context"),
        "response",
        tv["cont"].alias("content"),
        tv["gram"].alias("grammar"),
        tv["appr"].alias("appropriateness"),
        rel.alias("relevance"),
    )
    return out
