"""Hard-example mining by rank disagreement: P12, J5, J7, J8, A12, A13, T1, T2.

The run table's rows get their places, are unpivoted once into ``(place,
column_name, value)``, and every column is ranked with the distributed average
rank; one aggregate by place brings a row's ranks together, and all pairs of
columns are compared inside the row. Column pairing (J7 / J8) works on column
*names* (schema metadata), never on rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.operators.identity import PLACE, placed
from turnscore.operators.ranks import PER_RANGE, average_rank
from turnscore.schemas import GOLD_TO_PREDICTED, HARD_SET_SIZE

MEAN_DIFF = "mean_diff"


# How the columns of a run table are told apart. Gold ratings, and
# the scores of each metric family (a family's key is part of the metric's name).
GOLD_COLUMNS = ("startswith", "annotation")
SCORE_COLUMNS = {"am": ("endswith", "scores"), "llm": ("startswith", "LLM")}


def _named(columns: Sequence[str], rule: tuple[str, str]) -> list[str]:
    test, text = rule
    return [c for c in columns if getattr(c, test)(text)]


def discover_columns(columns: Sequence[str], metric: str = "LLM") -> tuple[list[str], list[str]]:
    """The gold columns of a run table and the score columns of a metric's
    family (the model scores' family unless the name says otherwise)."""
    family = next((f for f in SCORE_COLUMNS if f in metric.lower()), "llm")
    return _named(columns, GOLD_COLUMNS), _named(columns, SCORE_COLUMNS[family])


def _ids(id_col: str | Sequence[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


def to_long(df: DataFrame, gold: Sequence[str], pred: Sequence[str], id_col: str | Sequence[str] = "dialogue_id") -> DataFrame:
    """Unpivot discovered columns to ``(id..., column_name, role, value)``; names
    may hold dots, NaN becomes NULL. A row's place is carried along."""
    cols = [(c, "gold") for c in gold] + [(c, "pred") for c in pred]
    value = {c: F.col(f"`{c}`").cast("double") for c, _ in cols}
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(role).alias("role"), F.when(~F.isnan(value[c]), value[c]).alias("value"))
        for c, role in cols
    ])
    ids = [F.col(f"`{c}`") for c in _ids(id_col)]
    return df.select(*ids, *[PLACE] * (PLACE in df.columns), F.inline(cells))


def column_ranks(long: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """Average rank of every value within its column (W3 per column)."""
    return average_rank(long, "value", ["column_name"], "rank", per_range)


def row_ranks(run: DataFrame, gold: Sequence[str], pred: Sequence[str], id_col: str | Sequence[str] = "dialogue_id",
              per_range: int = PER_RANGE) -> DataFrame:
    """One row per row of the run table: ids, place, ``_values`` and ``_ranks``
    (arrays in the order of the gold and then the score columns). A row is its
    place, so rows that share ids or all values stay apart; one aggregate by
    place gathers a row's ranks (as many as there are columns)."""
    rows, _ = placed(run.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*_ids(id_col), *gold, *pred))], *[PLACE] * (PLACE in run.columns)))
    ranked = column_ranks(to_long(rows, gold, pred, id_col), per_range)
    each = [F.col("column_name") == c for c in (*gold, *pred)]
    return ranked.groupBy(*_ids(id_col), PLACE).agg(
        F.array(*[F.max(F.when(c, F.col("value"))) for c in each]).alias("_values"), F.array(*[F.max(F.when(c, F.col("rank"))) for c in each]).alias("_ranks"))


def _short(name: str) -> str:
    for sep in (".", "_"):
        if sep in name:
            return name.split(sep, 1)[1]
    return name


def suffix_pairs(gold: Sequence[str], pred: Sequence[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """J8 on names: pair each gold column with the predicted column whose name
    ends with the mapped quality. Returns the pairs and the names with zero
    or several candidates (reported, skipped)."""
    pairs, problems = [], []
    for g in gold:
        short = _short(g)
        mapped = GOLD_TO_PREDICTED.get(short, short)
        cands = [p for p in pred if p.endswith(mapped)]
        if len(cands) == 1:
            pairs.append((g, cands[0]))
        else:
            problems.append(g)
    return pairs, problems


def _gap(columns: Sequence[str], pair: tuple[str, str]) -> Column:
    rank = [F.col("_ranks")[list(columns).index(c)] for c in pair]
    return F.abs(rank[0] - rank[1])


def rank_differences(ranked: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]],
                     id_col: str | Sequence[str] = "dialogue_id") -> DataFrame:
    """``|gold_rank - pred_rank|`` per row and column pair, from
    :func:`row_ranks` over ``columns``, inside each row."""
    if not pairs:
        raise ValueError(f"no gold column has a score column to compare with among {list(columns)}")
    cells = F.array(*[F.struct(F.lit(g).alias("gold_col"), F.lit(p).alias("pred_col"), F.lit(f"{g}_vs_{p}").alias("pair"),
                               _gap(columns, (g, p)).alias("rank_diff")) for g, p in pairs])
    return ranked.select(*_ids(id_col), PLACE, F.inline(cells))


def cross_pairs(gold: Sequence[str], pred: Sequence[str]) -> list[tuple[str, str]]:
    """J7 on names: every gold column with every predicted column."""
    return [(g, p) for g in gold for p in pred]


def mean_rank_gap(columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> Column:
    """Mean absolute rank difference of a row of :func:`row_ranks`, missing
    values ignored."""
    if not pairs:
        raise ValueError(f"no gold column has a score column to compare with among {list(columns)}")
    known = F.filter(F.array(*[_gap(columns, p) for p in pairs]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def column_pairs(columns: Sequence[str], metric: str = "LLM") -> tuple[list[tuple[str, str]], list[str]]:
    """Pairs of gold and score columns (by suffix when the counts agree, else all
    with all) and the gold columns left without a single counterpart."""
    gold, pred = discover_columns(columns, metric)
    return suffix_pairs(gold, pred) if len(gold) == len(pred) else (cross_pairs(gold, pred), [])


def rank_disagreement(
    run: DataFrame, metric: str = "LLM", id_col: str | Sequence[str] = "dialogue_id", per_range: int = PER_RANGE
) -> DataFrame:
    """E4 core: discover, rank, pair, average the gaps. ``(id..., mean_diff)``,
    one row per row of the run table, also where ids repeat or rows are equal.
    ``id_col`` may name several columns, such as the dialogue and its model.
    Gold columns without a counterpart are warned of; none at all is an error."""
    gold, pred = discover_columns(run.columns, metric)
    pairs, unmatched = column_pairs(run.columns, metric)
    if unmatched:
        warnings.warn(f"no single score column for {unmatched}; they are left out", stacklevel=2)
    gap = mean_rank_gap([*gold, *pred], pairs)
    return row_ranks(run, gold, pred, id_col, per_range).select(*_ids(id_col), gap.alias(MEAN_DIFF))


def ranking_table(
    run: DataFrame, metric: str = "LLM", id_col: str | Sequence[str] = "dialogue_id", per_range: int = PER_RANGE
) -> DataFrame:
    """The ranking with what it rests on: ids, ``mean_diff`` and, by column name,
    ``scores`` and ``ranks``, by pair the ``gaps``; largest gap first, one row
    per row of the run table."""
    ids = _ids(id_col)
    gold, pred = discover_columns(run.columns, metric)
    pairs, _ = column_pairs(run.columns, metric)
    columns = [*gold, *pred]
    names = F.array(*[F.lit(c) for c in columns])
    gaps = F.create_map(*[x for p in pairs for x in (F.lit("_vs_".join(p)), _gap(columns, p))])
    rows = row_ranks(run, gold, pred, id_col, per_range).select(
        *ids, mean_rank_gap(columns, pairs).alias(MEAN_DIFF), F.map_from_arrays(names, "_values").alias("scores"),
        F.map_from_arrays(names, "_ranks").alias("ranks"), gaps.alias("gaps"))
    return rows.orderBy(F.desc_nulls_last(MEAN_DIFF), *ids)


def sort_by_gap(df: DataFrame, gap: str = MEAN_DIFF, id_col: str | Sequence[str] = "dialogue_id") -> DataFrame:
    """Largest gap first, id as tie-break (a range-partitioned sort)."""
    return df.orderBy(F.col(gap).desc_nulls_last(), *_ids(id_col))


def hardest(df: DataFrame, n: int = HARD_SET_SIZE, gap: str = MEAN_DIFF,
            id_col: str | Sequence[str] = "dialogue_id") -> DataFrame:
    """The first ``n`` of the ranking (TakeOrderedAndProject: each
    partition keeps its own top n, so only n rows per partition move)."""
    return sort_by_gap(df, gap, id_col).limit(n)


def source_share(hard: DataFrame, model: str = "model") -> DataFrame:
    """Share of each response source among the hardest rows."""
    from pyspark.sql import Window

    counts = hard.groupBy(model).agg(F.count(F.lit(1)).alias("n"))
    # one row per source of a bounded (top-n) set: the unpartitioned window
    # sums at most n rows
    return counts.select(model, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def hard_subset(dataset: DataFrame, ids: DataFrame, id_col: str = "dialogue_id") -> DataFrame:
    """Keep dataset rows whose id is among the hardest. ``ids`` is the
    top-n of a ranking; AQE broadcasts it when it is small."""
    return dataset.join(ids.select(id_col), id_col, "left_semi")
