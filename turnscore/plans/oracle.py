"""DuckDB twins of the adapters (FIXTURES.md 2.1 recipes), as named CTEs.

``sql(body, *ctes)`` prepends the requested CTEs (and what they depend on)
to a final SELECT. These strings are test material: the driver runs them on
the same parquet tables to check every query of the registry.
"""

from __future__ import annotations

from turnscore.functions.text import WIDE_SPACES
from turnscore.schemas import QUALITIES
from turnscore.sources.catalogue import DATASET_NAMES, catalogue_rows, mapping_rows, sql_values

_Q_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUALITIES))
_DS_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(DATASET_NAMES))
NUM_RE = (
    r"^[+-]?(((\d(_?\d)*)?\.\d(_?\d)*|\d(_?\d)*\.?)([eE][+-]?\d(_?\d)*)?|nan|inf|infinity)$"
)
SPLIT_RE = "[:;|,!? \t\n]"
WS = "' \t\n\r' || chr(11) || chr(12) || " + " || ".join(f"chr({c})" for c in WIDE_SPACES)


def rating_sql(k: int, qi: str = "qi", dialogue: str = "dialogue_id", turn: str = "turn_id") -> str:
    return f"CAST(1 + ({dialogue}*7 + {turn}*13 + {k * 5} + {qi}*11 + length(text)*{k + 1}) % 5 AS DOUBLE)"


def gold_sql(qi: str) -> str:
    r = [rating_sql(k, qi) for k in range(3)]
    return f"CASE WHEN (dialogue_id + turn_id + {qi}) % 11 <> 0 THEN ({r[0]} + {r[1]} + {r[2]}) / 3 END"


def tenths_sql(qi: str) -> str:
    return f"(10 + (length(text)*3 + dialogue_id*5 + {qi}*7) % 41)"


def num_text_sql(qi: str) -> str:
    t = tenths_sql(qi)
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR))"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "quals": ((), f"SELECT * FROM (VALUES {_Q_VALUES}) AS q(qi, quality)"),
    "turns": (
        (),
        """SELECT printf('TEST-%04d-%04d', conv_id, turn) AS uid, conv_id AS dialogue_id, turn AS turn_id,
       CASE WHEN role = 'assistant' THEN 'Chatbot' ELSE 'User' END AS sid,
       'DS' || CAST(conv_id % 4 AS VARCHAR) AS cid,
       CASE conv_id % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'ZH' ELSE 'ES' END AS language,
       CASE WHEN conv_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS supervised,
       role, text
FROM conversations""",
    ),
    "rl": (
        ("turns", "quals"),
        f"""SELECT t.*, q.qi, q.quality,
       {rating_sql(0)} AS r0, {rating_sql(1)} AS r1, {rating_sql(2)} AS r2,
       {gold_sql('qi')} AS gold,
       {tenths_sql('qi')} / 10 AS score
FROM turns t CROSS JOIN quals q""",
    ),
    "gold_wide": (
        ("turns",),
        f"""SELECT uid AS "UID", uid AS "UID_TEST", cid AS "CID", sid AS "SID", supervised AS "SUPERVISED",
       language AS "LANGUAGE", {gold_sql('0')} AS "APPROPRIATENESS", {gold_sql('1')} AS "CONTENT_RICHNESS",
       {gold_sql('2')} AS "GRAMMATICAL_CORRECTNESS", {gold_sql('3')} AS "RELEVANCE"
FROM turns""",
    ),
    "scores_wide": (
        ("turns",),
        f"""SELECT uid, dialogue_id, turn_id, sid, text,
       {tenths_sql('0')} / 10 AS appropriateness, {tenths_sql('1')} / 10 AS richness,
       {tenths_sql('2')} / 10 AS grammatical, {tenths_sql('3')} / 10 AS relevance
FROM turns""",
    ),
    "submission": (
        ("scores_wide",),
        """SELECT uid AS "UID", appropriateness AS "APPROPRIATENESS", richness AS "CONTENT_RICHNESS",
       grammatical AS "GRAMMATICAL_CORRECTNESS", relevance AS "RELEVANCE" FROM scores_wide
WHERE (dialogue_id + turn_id) % 19 <> 0""",
    ),
    "replies": (
        ("turns",),
        f"""SELECT uid, dialogue_id, turn_id, sid, text,
  CASE (dialogue_id + turn_id) % 6
    WHEN 0 THEN 'appropriateness: ' || {num_text_sql('0')} || ', richness: ' || {num_text_sql('1')}
                || ', grammatical: ' || {num_text_sql('2')} || ', relevance: ' || {num_text_sql('3')}
    WHEN 1 THEN {num_text_sql('0')} || ' because the reply fits the context'
    WHEN 2 THEN 'the reply reads well and stays on topic'
    WHEN 3 THEN 'Appropriateness|' || {num_text_sql('0')} || ';richness;;' || {num_text_sql('1')}
                || chr(9) || 'grammatical?' || {num_text_sql('2')} || ' relevance:'
    WHEN 4 THEN 'relevance is about ' || {num_text_sql('3')} || '! appropriateness roughly '
                || {num_text_sql('0')} || '!'
    ELSE '' END AS reply
FROM turns""",
    ),
    "dsnames": ((), f"SELECT * FROM (VALUES {_DS_VALUES}) AS d(dataset_idx, dataset)"),
    "drows0": (
        ("turns", "dsnames"),
        f"""SELECT t.uid, t.dialogue_id AS conv_id, t.turn_id, t.sid, t.text, d.dataset,
       'model-' || CAST(t.dialogue_id % 5 AS VARCHAR) AS model,
       coalesce(string_agg(t.text, chr(10)) OVER (PARTITION BY t.dialogue_id ORDER BY t.turn_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context,
       CASE WHEN (t.dialogue_id + t.turn_id) % 17 = 0 THEN '' ELSE t.text END AS response
FROM turns t JOIN dsnames d ON d.dataset_idx = t.dialogue_id % {len(DATASET_NAMES)}""",
    ),
    "drows": (
        ("drows0",),
        """SELECT uid AS dialogue_id, conv_id, turn_id, sid, text, dataset, model, context, response,
       '[zh] ' || context AS context_zh, '[es] ' || context AS context_es, ' ' || context || ' ' AS context_pa,
       '[zh] ' || response AS response_zh, '[es] ' || response AS response_es,
       chr(12288) || '  ' || response || chr(9) || chr(12288) AS response_pa
FROM drows0""",
    ),
    "cat": ((), "SELECT * FROM " + sql_values(catalogue_rows(),
            ["dataset_idx", "dataset", "rule", "annotation", "position", "n_annotations", "path"])),
    "qmap": ((), "SELECT * FROM " + sql_values(mapping_rows(), ["dataset", "quality", "source", "weight"])),
    "alists": (
        ("drows", "cat"),
        f"""SELECT r.dialogue_id, r.conv_id, r.turn_id, r.dataset, c.annotation, c.position, c.rule,
       CASE WHEN (r.conv_id + r.turn_id + c.position) % 11 = 0 THEN []::DOUBLE[]
            ELSE [{rating_sql(0, 'c.position', 'r.conv_id', 'r.turn_id')},
                  {rating_sql(1, 'c.position', 'r.conv_id', 'r.turn_id')},
                  {rating_sql(2, 'c.position', 'r.conv_id', 'r.turn_id')}] END AS ratings
FROM drows r JOIN cat c ON c.dataset = r.dataset""",
    ),
    "arows": (
        ("drows",),
        """SELECT dialogue_id, conv_id, turn_id + again AS turn_id, text, dataset,
       CASE WHEN again = 1 THEN 'model-x' ELSE model END AS model, row_number() OVER () AS rid
FROM (SELECT *, unnest(CASE WHEN conv_id % 13 = 0 THEN [0, 1] WHEN conv_id % 17 = 0 THEN [0, 0] ELSE [0] END) AS again FROM drows)""",
    ),
    "alists2": (
        ("arows", "cat"),
        f"""SELECT r.rid, r.dialogue_id, r.model, r.dataset, c.annotation, c.rule,
       CASE WHEN (r.conv_id + r.turn_id + c.position) % 11 = 0 THEN []::DOUBLE[]
            ELSE [{rating_sql(0, 'c.position', 'r.conv_id', 'r.turn_id')},
                  {rating_sql(1, 'c.position', 'r.conv_id', 'r.turn_id')},
                  {rating_sql(2, 'c.position', 'r.conv_id', 'r.turn_id')}] END AS ratings
FROM arows r JOIN cat c ON c.dataset = r.dataset""",
    ),
    "subrows": (
        ("scores_wide",),
        """SELECT uid AS "UID", (dialogue_id * 100 + turn_id) * 2 + again AS pos,
       CASE WHEN again = 0 THEN appropriateness ELSE 5.5 - appropriateness END AS "APPROPRIATENESS",
       CASE WHEN again = 0 THEN richness ELSE 5.5 - richness END AS "CONTENT_RICHNESS",
       CASE WHEN again = 0 THEN grammatical ELSE 5.5 - grammatical END AS "GRAMMATICAL_CORRECTNESS",
       CASE WHEN again = 0 THEN relevance ELSE 5.5 - relevance END AS "RELEVANCE"
FROM (SELECT *, unnest(CASE WHEN (dialogue_id + turn_id) % 7 = 0 THEN [0, 1] ELSE [0] END) AS again FROM scores_wide
      WHERE (dialogue_id + turn_id) % 19 <> 0)""",
    ),
    "subfirst": (
        ("subrows",),
        """SELECT *, count(*) OVER (PARTITION BY "UID") - 1 AS n_duplicates FROM subrows
QUALIFY row_number() OVER (PARTITION BY "UID" ORDER BY pos) = 1""",
    ),
    "rehearsal_in": (
        ("turns",),
        f"""SELECT uid AS id, sid, text AS response,
       {rating_sql(0, '0')} AS p_appr, {rating_sql(0, '1')} AS p_cont,
       {rating_sql(0, '2')} AS p_gram, {rating_sql(0, '3')} AS p_rel,
       CASE WHEN dialogue_id % 5 <> 0 THEN {rating_sql(1, '0')} END AS o_appr,
       CASE WHEN dialogue_id % 5 <> 0 THEN {rating_sql(1, '1')} END AS o_cont,
       CASE WHEN dialogue_id % 5 <> 0 THEN {rating_sql(1, '2')} END AS o_gram,
       CASE WHEN dialogue_id % 5 <> 0 THEN {rating_sql(1, '3')} END AS o_rel,
       dialogue_id, turn_id
FROM turns""",
    ),
    "store": (
        (),
        """SELECT vec_id AS ex_id, embedding, 'context of example ' || CAST(vec_id AS VARCHAR) AS context,
       'response of example ' || CAST(vec_id AS VARCHAR) AS response,
       CAST(1 + label % 5 AS DOUBLE) AS q_appropriateness,
       CAST(1 + (label + 1) % 5 AS DOUBLE) AS q_richness,
       CAST(1 + (label + 2) % 5 AS DOUBLE) AS q_grammatical,
       CASE WHEN label % 2 = 0 THEN CAST(1 + (label + 3) % 5 AS DOUBLE) END AS q_relevance,
       label
FROM embeddings""",
    ),
    "rq": ((), "SELECT vec_id AS query_id, embedding AS qvec FROM embeddings"),
    "emb_records": (
        (),
        """SELECT printf('EMB-%05d', vec_id) AS dialogue_id, vec_id, embedding,
       1 + (vec_id * 7 % 41) / 10 AS score,
       CASE WHEN label <> 0 THEN CAST(1 + label % 5 AS DOUBLE) END AS gold, label
FROM embeddings""",
    ),
    "labdocs": (
        (),
        """SELECT l.doc_id, d.lang, d.source, CAST(l.quality AS DOUBLE) AS gold, CAST(d.n_chars AS DOUBLE) AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    ),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for dep in CTES[n][0]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, *ctes: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named base CTEs (plus ``extra`` CTEs, in order) ``body``."""
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in _order(ctes)]
    for n, q in (extra or {}).items():
        parts.append(f"{n} AS (\n{q}\n)")
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def avg_rank_sql(value: str, partition: str) -> str:
    """Average-tie rank in the window form (oracle only)."""
    p = f"PARTITION BY {partition} " if partition else ""
    p2 = f"PARTITION BY {partition}, {value}" if partition else f"PARTITION BY {value}"
    return f"(rank() OVER ({p}ORDER BY {value}) + (count(*) OVER ({p2}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def trim_ws_sql(x: str) -> str:
    return f"trim({x}, {WS})"


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, values: dict[str, str]) -> str:
    """DuckDB twin of :func:`turnscore.functions.prompts.render`."""
    from turnscore.functions.prompts import template_parts

    pieces = [lit_sql(x) if k == "lit" else values.get(x, "''") for k, x in template_parts(template)]
    return "(" + " || ".join(pieces) + ")"


def py_float_sql(x: str) -> str:
    t = f"lower({trim_ws_sql(x)})"
    return f"CASE WHEN regexp_matches({t}, '{NUM_RE}') THEN CAST(replace({t}, '_', '') AS DOUBLE) END"


def first_token_sql(x: str) -> str:
    tok = f"regexp_extract({x}, '^[ \\t\\n\\r\\x0b\\x0c]*([^ \\t\\n\\r\\x0b\\x0c]+)', 1)"
    return f"CASE WHEN {tok} <> '' THEN {tok} END"


def parse_multi_sql(reply: str, quality: str) -> str:
    names = "['appropriateness', 'richness', 'grammatical', 'relevance']"
    words = f"string_split_regex(lower({reply}), '{SPLIT_RE.replace(chr(9), chr(92) + 't').replace(chr(10), chr(92) + 'n')}')"
    pos = f"list_position({words}, '{quality}')"
    cands = (f"list_filter({words}, lambda w, i: i > coalesce({pos}, 1000000000) AND "
             f"(list_contains({names}, w) OR regexp_matches(lower({trim_ws_sql('w')}), '{NUM_RE}')))")
    first = f"{cands}[1]"
    return f"CASE WHEN {pos} IS NOT NULL AND NOT list_contains({names}, {first}) THEN {py_float_sql(first)} END"
