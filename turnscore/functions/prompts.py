"""Prompts: F1_render_prompt, F2_render_examples, M4_prompt_table.

A template is split once, on the driver, at its placeholders; rendering is
then ``concat(literal, column, literal, ...)`` on the JVM side. Unlike chained
``str.format`` / ``replace`` this is safe when a context itself contains a
placeholder such as ``{response}``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.schemas import DEFAULT_MISSING_SCORE, QUALITIES

#: What each quality asks for, in our own words.
_RUBRICS = {
    "appropriateness": "A fitting reply takes up what was just said and could come next in a real talk.",
    "richness": "A rich reply tells something: it brings in facts, names or feelings and goes beyond stock phrases.",
    "grammatical": "A well-formed reply reads smoothly, with no slip in grammar, spelling or word choice.",
    "relevance": "A relevant reply keeps to the matter that the speakers are on.",
}

_ASK_FOOT = """
{positive_examples}
Talk so far:
{dialogue_context}
Next reply:
{response}
"""

#: One wording per family of prompt names: how the task is put, on which scale,
#: and how the answer is to be given.
_WORDINGS = {
    "base-simple": "You see a talk and its next reply. Mark the reply from 1 to 5 on every point below.",
    "base-positive": "You see a talk and its next reply. Recall replies you would be glad to get, then mark this one from 1 to 5 "
                     "on every point below.",
    "op-all": "Act as a judge of chat replies. Mark the reply on every point below with a decimal number from 1.0 to 5.0.",
    "comparable": "How good is the next reply as a turn of this talk? Mark its {quality} with a number from 1 to 5.",
    "comparable-digit": "How good is the next reply as a turn of this talk? Mark its {quality} with one digit, 1 2 3 4 or 5.",
    "op-digit": "Act as a judge of chat replies. Mark the {quality} of the reply by one digit from 1 to 5, with no other sign.",
    "mlop": "Weigh the reply aloud in one sentence, then mark its {quality} between 1.1 and 4.9; begin with the number.",
    "ml": "Mark the {quality} of the reply with a whole number from 1 to 5.",
    "vh": "Mark the {quality} of the reply with a floating-point number between 1 and 5, such as 2.75.",
}
_EXAMPLE_INTRO = {
    "none": "",
    "static": " {n} marked talks, chosen in advance, come first.",
    "retrieved": " {n} marked talks, found for their likeness to this one, come first.",
}

EXAMPLE_BLOCK = "\nMarked talks, a dashed line after each:\n{positive_examples}\n\nNow the one to mark.\n"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's prompt registry): the line between
# examples; prompt name -> (qualities, examples kind, number of examples,
# example dataset).
# ---------------------------------------------------------------------------
EXAMPLE_SEPARATOR = "\n----------\n"
APPR, REL, RICH, GRAM, ALL4 = ("appropriateness",), ("relevance",), ("richness",), ("grammatical",), QUALITIES
PROMPTS: dict[str, tuple[tuple[str, ...], str, int, str | None]] = {
    "base-simple-prompt": (ALL4, "none", 0, None),
    "base-positive-examples-prompt": (ALL4, "none", 0, None),
    "comparable-no-egs": (APPR, "none", 0, None),
    "comparable-no-egs-single_digit": (APPR, "none", 0, None),
    "comparable-2-egs-dd-zhao": (APPR, "static", 2, "dailydialog-zhao"),
    "comparable-2-dyn-egs-dd-zhao": (APPR, "retrieved", 2, "dailydialog-zhao"),
    "comparable-4-dyn-egs-dd-zhao": (APPR, "retrieved", 4, "dailydialog-zhao"),
    "comparable-8-dyn-egs-dd-zhao": (APPR, "retrieved", 8, "dailydialog-zhao"),
    "op-appropriateness-single_digit-fasttext": (APPR, "none", 0, None),
    "op-appropriateness-single_digit-fasttext-egs-dd-zhao-2-01": (APPR, "static", 2, "dailydialog-zhao"),
    "mlop-appropriateness-03": (APPR, "none", 0, None),
    "mlop-appropriateness-egs-dd-zhao-2-02": (APPR, "static", 2, "dailydialog-zhao"),
    "mlop-appropriateness-dyn-egs-dd-zhao-2-02": (APPR, "retrieved", 2, "dailydialog-zhao"),
    "mlop-appropriateness-egs-rh-copy-4-02": (APPR, "static", 4, "rehearsal-copy-hard"),
    "ml-appropriateness-04": (APPR, "none", 0, None),
    "vh-appropriateness-03": (APPR, "none", 0, None),
    "vh-appropriateness-2egs-dd-zhao-03": (APPR, "static", 2, "dailydialog-zhao"),
    "vh-appropriateness-2egs-dd-zhao-retrieval-01": (APPR, "retrieved", 2, "dailydialog-zhao"),
    "vh-relevance-01": (REL, "none", 0, None),
    "vh-relevance-2egs-dd-zhao-02": (REL, "static", 2, "dailydialog-zhao"),
    "vh-relevance-2egs-dd-zhao-retrieval-01": (REL, "retrieved", 2, "dailydialog-zhao"),
    "vh-richness-02": (RICH, "none", 0, None),
    "vh-02-richness-2egs-dd-zhao": (RICH, "static", 2, "dailydialog-zhao"),
    "vh-grammatical-02": (GRAM, "none", 0, None),
    "vh-grammatical-2egs-dd-zhao-02": (GRAM, "static", 2, "dailydialog-zhao"),
    "op-all-02": (ALL4, "none", 0, None),
    "op-all-egs-rehearsal-copy-hard5-02": (ALL4, "static", 5, "rehearsal-copy-hard"),
}
# ---------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"\{(dialogue_context|response|positive_examples)\}")


@dataclass(frozen=True)
class Prompt:
    name: str
    qualities: tuple[str, ...]
    examples: str
    n_examples: int
    dataset: str | None
    template: str
    example_template: str
    expected_reply: str
    default_missing_value: float = DEFAULT_MISSING_SCORE


def _family(name: str) -> str:
    """The wording of a prompt name."""
    if name.startswith("base-positive"):
        return "base-positive"
    digit = "single_digit" in name
    for start, family in (("base", "base-simple"), ("op-all", "op-all"), ("comparable", "comparable-digit" if digit else "comparable"),
                          ("op-", "op-digit"), ("mlop", "mlop"), ("ml-", "ml")):
        if name.startswith(start):
            return family
    return "vh"


def get_prompt(name: str) -> Prompt:
    """M4: look up a registered prompt; unknown names are an error."""
    if name not in PROMPTS:
        raise KeyError(f"unknown prompt {name!r}")
    qualities, kind, n, dataset = PROMPTS[name]
    head = _WORDINGS[_family(name)] + _EXAMPLE_INTRO[kind].replace("{n}", str(n))
    shown = "Talk so far:\n{dialogue_context}\nNext reply:\n{response}\n"
    if len(qualities) > 1:
        points = "".join(f"{q}: {_RUBRICS[q]}\n" for q in qualities)
        tpl = f"{head}\n{points}Give a line of the form 'name: number' for each point.{_ASK_FOOT}Marks:\n"
        ex = shown + "Marks:\n" + "".join(f"{q}: {{{q}}}\n" for q in qualities)
        reply = ", ".join(f"{q}: {{{q}}}" for q in qualities)
    else:
        q = qualities[0]
        tpl = f"{head.replace('{quality}', q)} {_RUBRICS[q]}{_ASK_FOOT}{q}:"
        ex = shown + f"{q}: {{{q}}}\n"
        reply = f"{{{q}}}"
    return Prompt(name, qualities, kind, n, dataset, tpl, ex, reply)


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ``("lit", text)`` and ``("col", placeholder)``."""
    out, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def render(template: str, values: dict[str, Column]) -> Column:
    """F1 core: fill the placeholders of ``template`` with columns."""
    pieces = []
    for kind, x in template_parts(template):
        pieces.append(F.lit(x) if kind == "lit" else values.get(x, F.lit("")))
    return F.concat(*pieces)


def render_prompt(prompt: Prompt, context: Column | str = "context", response: Column | str = "response",
                  examples: Column | None = None) -> Column:
    """the prompt text of a turn; the example block is empty when the
    prompt has none."""
    c = F.col(context) if isinstance(context, str) else context
    r = F.col(response) if isinstance(response, str) else response
    return render(prompt.template, {
        "dialogue_context": c, "response": r, "positive_examples": examples if examples is not None else F.lit("")
    })


def rating_text(v: Column) -> Column:
    """A rating as text; a missing one (a backup example lacking the
    quality) renders as ``n/a``."""
    return F.coalesce(v.cast("string"), F.lit("n/a"))


def render_example(prompt: Prompt, context: Column, response: Column, ratings: dict[str, Column]) -> Column:
    """One rated example in the prompt's nested template."""
    pieces = []
    for kind, x in _split_example(prompt.example_template):
        if kind == "lit":
            pieces.append(F.lit(x))
        elif x == "dialogue_context":
            pieces.append(context)
        elif x == "response":
            pieces.append(response)
        else:
            pieces.append(rating_text(ratings[x]))
    return F.concat(*pieces)


def _split_example(tpl: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    for m in re.finditer(r"\{([a-z_]+)\}", tpl):
        if m.start() > pos:
            out.append(("lit", tpl[pos:m.start()]))
        out.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(tpl):
        out.append(("lit", tpl[pos:]))
    return out


def examples_block(df: DataFrame, group: Sequence[str], order: str, text: str) -> DataFrame:
    """per group, the rendered examples in ``order``, joined by the
    separator and wrapped in the block header/footer. A group holds at most
    the prompt's ``n`` examples."""
    agg = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text)))).alias("_ex"))
    joined = F.array_join(F.transform("_ex", lambda s: s[text]), EXAMPLE_SEPARATOR)
    block = render(EXAMPLE_BLOCK, {"positive_examples": joined})
    return agg.select(*group, block.alias("examples"))


def check_names(names: Sequence[str]) -> list[str]:
    """M4 registry rules: names are unique and registered."""
    names = list(names)
    if len(set(names)) != len(names):
        raise ValueError("duplicate prompt names")
    for n in names:
        get_prompt(n)
    return names


def prompt_table(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """M4 as a config DataFrame (one row per prompt, names unique), with the
    template's pieces: literals (``col`` null) and places of columns."""
    names = check_names(names or PROMPTS)
    rows = []
    for n in names:
        p = get_prompt(n)
        parts = [(x if k == "lit" else None, x if k == "col" else None) for k, x in template_parts(p.template)]
        rows.append((n, list(p.qualities), p.examples, p.n_examples, p.dataset, parts))
    return spark.createDataFrame(
        rows, "prompt string, qualities array<string>, examples string, n_examples int, dataset string, "
              "parts array<struct<lit: string, col: string>>"
    )


def render_parts(parts: Column, context: Column, response: Column, examples: Column | None = None) -> Column:
    """F1 for a prompt that is data: the pieces of a ``prompt_table`` row filled
    with a turn's columns."""
    filled = F.transform(parts, lambda p: F.coalesce(
        p["lit"], F.when(p["col"] == "dialogue_context", context).when(p["col"] == "response", response)
        .otherwise(examples if examples is not None else F.lit(""))))
    return F.array_join(filled, "")


def self_check(prompt: Prompt) -> None:
    """The reference's construction-time check: a dummy render and a filled
    expected reply must both work, and the reply must parse back."""
    for q in prompt.qualities:
        if q not in QUALITIES:
            raise ValueError(f"{q} not in {QUALITIES}")
    filled = prompt.expected_reply
    for q in prompt.qualities:
        filled = filled.replace("{" + q + "}", str(prompt.default_missing_value))
    if "{" in filled:
        raise ValueError(f"expected reply of {prompt.name} has unknown placeholders")
