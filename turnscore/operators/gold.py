"""Human ratings: A1, A2, A9, P7, P11, P13.

Gold lives in a long table ``(dataset, id, quality, gold)``; the quality
mapping (a few hundred fixed rows) travels inside the plan as a literal.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.schemas import DIMENSION_TO_QUALITY, TURN_DIMENSIONS
from turnscore.sources.catalogue import mapping_rows, quality_mapping


def aggregate_ratings(ratings: Column | str, rule: Column | str) -> Column:
    """A1: collapse one annotator list by the dataset's rule: ``mean`` or
    ``first``. An empty list gives NULL."""
    a = F.col(ratings) if isinstance(ratings, str) else ratings
    r = F.col(rule) if isinstance(rule, str) else rule
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), F.size(a))
    return F.when(r == "first", F.get(a, 0)).otherwise(mean)


def annotator_aggregate(lists: DataFrame, ratings: str = "ratings", rule: str = "rule") -> DataFrame:
    """A1 over a long annotator table (rule per row from the catalogue)."""
    return lists.withColumn("value", aggregate_ratings(ratings, rule))


def composite_quality(
    values: DataFrame, mapping: DataFrame | None = None, id_col: str | Sequence[str] = "dialogue_id",
    dataset: str = "dataset", annotation: str = "annotation", value: str = "value",
) -> DataFrame:
    """A2 over a long table of annotation values that holds no rows to work in
    (:func:`composite_rows` needs no grouping): quality = weighted mean of its
    mapped source annotations (a source listed twice has weight 2); any missing
    source makes it missing. ``id_col`` names what tells rows apart, such as
    dialogue, model and place; an id that still repeats gets NULL.
    Output ``(id..., dataset, quality, gold)``."""
    spark = values.sparkSession
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    m = F.broadcast(mapping if mapping is not None else quality_mapping(spark))
    j = values.join(m, (values[dataset] == m["dataset"]) & (values[annotation] == m["source"]))
    known = F.when(~F.isnan(F.col(value)), F.col(value))
    j = j.select(*[values[c].alias(c) for c in ids], values[dataset].alias(dataset), "quality", "weight", known.alias(value))
    n_sources = m.groupBy("dataset", "quality").agg(F.count(F.lit(1)).alias("_n_src"))
    agg = j.groupBy(*ids, dataset, "quality").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(value).alias("_n_present"),
        F.sum(F.col("weight") * F.col(value)).alias("_sw"),
        F.sum("weight").alias("_w"),
    )
    agg = agg.join(F.broadcast(n_sources), [dataset, "quality"])
    complete = (F.col("_n_present") == F.col("_n")) & (F.col("_n") == F.col("_n_src"))
    return agg.select(*ids, dataset, "quality", F.when(complete, F.col("_sw") / F.col("_w")).alias("gold"))


def quality_rules(rows: Sequence[tuple] | None = None) -> Column:
    """The mapping as one literal: dataset -> its qualities with their weighted
    sources. ``rows``: (dataset, quality, source, weight), by default the catalogue's."""
    rules: dict[str, dict[str, list]] = {}
    for dataset, quality, source, weight in mapping_rows() if rows is None else rows:
        rules.setdefault(dataset, {}).setdefault(quality, []).append({"source": source, "weight": float(weight)})
    listed = {d: [{"quality": q, "sources": s} for q, s in qs.items()] for d, qs in rules.items()}
    return F.from_json(F.lit(json.dumps(listed)), "map<string,array<struct<quality:string,sources:array<struct<source:string,weight:double>>>>>")


def row_qualities(values: Column, dataset: Column, rules: Column | None = None) -> Column:
    """A2 inside one row: from its ``values`` (map: annotation -> value) the list
    of ``(quality, gold)`` of its dataset. Gold is the weighted mean of the
    quality's sources, NULL where one is missing or NaN."""

    def gold(q: Column) -> Column:
        def known(s: Column) -> Column:
            v = F.try_element_at(values, s["source"])
            return F.when(~F.isnan(v), v)

        total = F.aggregate(q["sources"], F.lit(0.0), lambda a, s: a + s["weight"] * known(s))  # one NULL makes it NULL
        return total / F.aggregate(q["sources"], F.lit(0.0), lambda a, s: a + s["weight"])

    own = F.try_element_at(quality_rules() if rules is None else rules, dataset)
    return F.transform(own, lambda q: F.struct(q["quality"].alias("quality"), gold(q).alias("gold")))


def composite_rows(
    rows: DataFrame, mapping: Sequence[tuple] | None = None, keep: Sequence[str] = ("dialogue_id",),
    dataset: str = "dataset", values: str = "values",
) -> DataFrame:
    """A2: ``(keep..., dataset, quality, gold)`` of every row with a map of
    annotation values. Nothing is grouped and nothing moves, so rows that share
    an id, or all their values, keep their gold each."""
    found = row_qualities(F.col(values), F.col(dataset), None if mapping is None else quality_rules(mapping))
    return rows.select(*keep, dataset, F.inline(found))


def annotation_values(annotations: Column, names: Sequence[str], rule: Column) -> Column:
    """A1 over a struct of annotator lists: a map of annotation values."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[aggregate_ratings(annotations[n], rule) for n in names]))


def challenge_to_long(gold_wide: DataFrame, uid: str = "UID") -> DataFrame:
    """Challenge dimension columns -> ``(uid, quality, gold)``."""
    dims = [d for d in TURN_DIMENSIONS if d in gold_wide.columns]
    long = gold_wide.unpivot([uid], dims, "dimension", "gold")
    names = F.create_map(*[x for d in dims for x in (F.lit(d), F.lit(DIMENSION_TO_QUALITY[d]))])
    return long.select(F.col(uid).alias("uid"), F.element_at(names, F.col("dimension")).alias("quality"), "gold")


def drop_unlabelled(df: DataFrame, gold: str = "gold") -> tuple[DataFrame, DataFrame]:
    """Keep records with the target label (a NaN is none); also return a
    one-row report ``(n_total, n_missing)`` (computed lazily, one pass)."""
    has = F.col(gold).isNotNull() & ~F.isnan(F.col(gold).cast("double"))
    report = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~has).alias("n_missing"))
    return df.where(has), report


def or_default(c: Column | str, default: float) -> Column:
    """Value or default (``ifnone``) where it is NULL or NaN; a default of 0
    is respected."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(float(default))), F.lit(float(default)))


def label_coverage(
    spark: SparkSession, gold: DataFrame, datasets: DataFrame, qualities: tuple[str, ...],
    dataset: str = "dataset",
) -> DataFrame:
    """For every dataset and quality, whether the mapping defines it, how
    many rows the dataset has and how many of them lack gold. Datasets that
    map to no quality report ``mapped = false`` for all qualities."""
    m = quality_mapping(spark).select("dataset", "quality").distinct()
    q = F.explode(F.array(*[F.lit(x) for x in qualities])).alias("quality")
    rows = datasets.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows"))
    grid = rows.select(dataset, "n_rows", q)
    have = gold.groupBy(dataset, "quality").agg(F.count(F.when(~F.isnan("gold"), F.col("gold"))).alias("n_gold"))
    out = grid.join(F.broadcast(m.withColumn("mapped", F.lit(True))), [dataset, "quality"], "left")
    out = out.join(have, [dataset, "quality"], "left")
    return out.select(
        dataset, "quality",
        F.coalesce("mapped", F.lit(False)).alias("mapped"),
        "n_rows",
        (F.col("n_rows") - F.coalesce("n_gold", F.lit(0))).alias("n_missing"),
    )
