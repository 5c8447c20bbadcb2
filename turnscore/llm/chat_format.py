"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all turns before it are
context, and the loss mask covers the text of that reply alone. Turns that
follow the last assistant turn (or all turns, where there is none) would be
lost, so such a conversation also gives one row with an empty mask
(``trainable`` false) holding the whole conversation.

The template marks a turn ``<s>[ROLE]...[/ROLE]</s>`` with ``[INST]`` for
users, ``<<SYS>>`` for the system prompt, ``[ANSW]`` for the assistant and
``[TURN:role]`` for any other role. Inside roles and texts each of ``\\ [ ] <``
is followed by a backslash, so no control string can occur in a text, and
dropping those backslashes gives the text back exactly.

Cases: a null or empty text is an empty turn; a null role is a turn
``[TURN]`` (read back as an empty role); a null turn number sorts first; ties
on the turn number and repeated rows are all kept, ordered by (turn, role,
text); a null conversation id is one conversation of its own; an empty table
gives an empty result; extra columns are ignored.

A conversation is the unit of the result: its context is quadratic in its
length by definition of the method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPED = r"[\[\]<\\]"
TURN_END = "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({ESCAPED})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({ESCAPED})\\", "$1")


def _wrap(role: Column) -> tuple[Column, Column]:
    """Strings before and after a turn's text."""
    opening = (
        F.when(role == "user", F.lit("<s>[INST] "))
        .when(role == "system", F.lit("<s><<SYS>> "))
        .when(role == "assistant", F.lit("<s>[ANSW] "))
        .when(role.isNull(), F.lit("<s>[TURN] "))
        .otherwise(F.concat(F.lit("<s>[TURN:"), escape(role), F.lit("] ")))
    )
    closing = (
        F.when(role == "user", F.lit(" [/INST]"))
        .when(role == "system", F.lit(" <</SYS>>"))
        .when(role == "assistant", F.lit(" [/ANSW]"))
        .otherwise(F.lit(" [/TURN]"))
    )
    return opening, F.concat(closing, F.lit(TURN_END))


def prefix_targets(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per example: ``conv``, ``example`` (0-based), ``n_turns``,
    ``formatted``, ``loss_start``, ``loss_end`` (code points of ``formatted``,
    end exclusive), ``trainable``."""
    opening, closing = _wrap(F.col("_r"))
    body = escape(F.coalesce(F.col("_x"), F.lit("")))
    parts = (
        turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_n"), F.col(role).alias("_r"), F.col(text).alias("_x"))
        .select(
            "_c",
            F.struct(
                F.col("_n").alias("n"), F.col("_r").alias("r"), F.coalesce("_x", F.lit("")).alias("x"),
                F.concat(opening, body, closing).alias("piece"),
                F.length(opening).alias("before"), F.length(body).alias("size"),
            ).alias("p"),
        )
        .groupBy("_c")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
    )
    ends = F.filter(
        F.transform("ps", lambda p, i: F.when((p["r"] == "assistant") | (i == F.size("ps") - 1), i + 1)),
        lambda k: k.isNotNull(),
    )
    last = F.element_at("ps", F.col("k"))
    context = F.array_join(F.transform(F.slice("ps", 1, F.col("k") - 1), lambda p: p["piece"]), "")
    trainable = F.coalesce(last["r"] == "assistant", F.lit(False))
    start = F.length("context") + last["before"]
    return (
        parts.select("_c", "ps", F.posexplode(ends).alias("example", "k"))
        .select("_c", "example", "k", last.alias("l"), context.alias("context"), trainable.alias("trainable"),
                last["before"].alias("before"))
        .select(
            F.col("_c").alias(conv), "example", F.col("k").cast("long").alias("n_turns"),
            F.concat("context", F.col("l")["piece"]).alias("formatted"),
            F.when(F.col("trainable"), F.length("context") + F.col("before")).otherwise(0).cast("long").alias("loss_start"),
            F.when(F.col("trainable"), F.length("context") + F.col("before") + F.col("l")["size"]).otherwise(0).cast("long").alias("loss_end"),
            "trainable",
        )
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, TURN_END), lambda p: p != "")
    opening = r"(?s)^<s>(?:\[INST\]|\[ANSW\]|\[TURN\]|<<SYS>>|\[TURN:(?:[^\[\]<\\]|[\[\]<\\]\\)*+\]) "

    def one(p: Column) -> Column:
        role = (
            F.when(p.startswith("<s>[INST] "), F.lit("user"))
            .when(p.startswith("<s><<SYS>> "), F.lit("system"))
            .when(p.startswith("<s>[ANSW] "), F.lit("assistant"))
            .when(p.startswith("<s>[TURN] "), F.lit(""))
            .otherwise(unescape(F.regexp_extract(p, r"(?s)^<s>\[TURN:((?:[^\[\]<\\]|[\[\]<\\]\\)*+)\] ", 1)))
        )
        rest = F.regexp_replace(p, opening, "")
        closing = F.when(p.startswith("<s><<SYS>> "), F.length(F.lit(" <</SYS>>"))).otherwise(F.length(F.lit(" [/INST]")))
        return F.struct(
            role.alias("role"),
            unescape(F.substring(rest, F.lit(1), F.length(rest) - closing)).alias("text"),
        )

    return F.transform(pieces, one)


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the examples alone: ``n_turns``,
    ``turns_sha256`` (role, newline, text, newline per turn), ``loss_chars`` and
    ``loss_sha256`` (unescaped text under the masks, in order),
    ``formatted_chars`` (code points of all examples)."""
    reply = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = examples.groupBy(F.col(conv).alias("_c")).agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("example", reply.alias("t"))))), lambda e: e["t"]), ""
        ).alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.withColumn("turns", parse(F.col("whole"))).select(
        F.col("_c").alias(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
