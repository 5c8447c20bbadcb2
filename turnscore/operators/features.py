"""Embedding features: A14_token_pooling and J6_ensemble_features.

Pooling is row-local (higher-order array functions over one record's token
vectors), so it needs no shuffle at all. The ensemble groups at most N
member rows per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens_from_flat(vec: Column | str, n_tokens: int, dim: int) -> Column:
    """Cut a flat vector into ``n_tokens`` vectors of ``dim`` (fixture use:
    the driver's 64-dim embeddings become 8 tokens of 8)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(F.sequence(F.lit(0), F.lit(n_tokens - 1)), lambda t: F.slice(v, t * dim + 1, dim))


def max_and_avg_pool(tokens: Column | str) -> Column:
    """Element-wise max over the token vectors followed by the
    element-wise mean (``concat(max, avg)``), computed in double."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    dims = F.sequence(F.lit(0), F.size(F.get(t, 0)) - 1)
    col_j = lambda j: F.transform(t, lambda tok: F.get(tok, j).cast("double"))
    mx = F.transform(dims, lambda j: F.array_max(col_j(j)))
    avg = F.transform(
        dims, lambda j: F.aggregate(col_j(j), F.lit(0.0), lambda a, x: a + x) / F.size(t)
    )
    return F.concat(mx, avg)


def vector_summary(v: Column | str, prefix: str = "feat") -> list[Column]:
    """Scalar view of a vector for checks: size, sum, first, last."""
    c = F.col(v) if isinstance(v, str) else v
    return [
        F.size(c).cast("long").alias(f"n_{prefix}"),
        F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")).alias(f"{prefix}_sum"),
        F.get(c, 0).cast("double").alias(f"{prefix}_first"),
        F.get(c, F.size(c) - 1).cast("double").alias(f"{prefix}_last"),
    ]


def ensemble_features(
    members: DataFrame, n_members: int, id_col: str = "dialogue_id", member: str = "member",
    vec: str = "embedding", score: str | None = None,
) -> DataFrame:
    """Per id, the members' vectors concatenated in member order, each
    optionally followed by its predicted score; ``complete`` checks that all
    ``n_members`` are present (the reference asserts id agreement)."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    if score is not None:
        v = F.concat(v, F.array(F.col(score).cast("double")))
    agg = members.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(member).alias("m"), v.alias("v")))).alias("_parts"),
        F.count(F.lit(1)).alias("_n"),
    )
    return agg.select(
        id_col,
        F.flatten(F.transform("_parts", lambda s: s["v"])).alias("features"),
        (F.col("_n") == n_members).alias("complete"),
    )
