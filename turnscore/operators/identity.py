"""Row identity: a row is its place in the file that it was read from.

Values cannot name a row: ids repeat, and rows may be equal in every column.
:func:`with_place` adds ``(file, block, row)`` at the scan, where the order of
the three is the file's order whatever way Spark packs files into tasks.
:func:`placed` gives any DataFrame such places by writing it once as Parquet in
the shared checkpoint folder, so a task that is recomputed reads the same rows
under the same names.

:func:`occurrence` numbers the rows of a key in that order without gathering a
key's rows in one task: rows are numbered inside their block, and a prefix over
the key's blocks is added."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from turnscore.session import scratch_path

PLACE = "_place"
#: Rows of one file that count as one block where the reader has no smaller unit.
BLOCK_ROWS = 1 << 16


def with_place(df: DataFrame, fmt: str, name: str = PLACE) -> DataFrame:
    """``df``, just read (``fmt``: parquet, csv, json, text), with its rows'
    places: a struct of file path, block and row, ordered as the files are. The
    row of a text format counts on across the blocks of a task, so it orders
    rows but says nothing by itself."""
    meta = F.col("_metadata")
    if fmt == "parquet":
        block, row = F.floor(meta["row_index"] / BLOCK_ROWS).cast("long"), meta["row_index"]
    else:
        block, row = meta["file_block_start"], F.monotonically_increasing_id()
    place = F.struct(meta["file_path"].alias("file"), block.alias("block"), row.alias("row"))
    return df.select("*", place.alias(name))


def written(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written once in the shared checkpoint folder and read back, and
    the given aggregates of it, observed while it is written (no second pass)."""
    path = scratch_path(df.sparkSession, "written")
    seen = Observation()
    if metrics:
        df = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), (seen.get if metrics else {})


def placed(df: DataFrame, name: str = PLACE, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` with a place for every row (kept if it has one already), and
    observed aggregates."""
    if name in df.columns:
        return written(df, **metrics)
    back, seen = written(df, **metrics)
    return with_place(back, "parquet", name), seen


def occurrence(df: DataFrame, key: str | Sequence[str], name: str = "_nth", place: str = PLACE) -> DataFrame:
    """Adds the number (from 1) of each row among those of its key, in order of
    their places."""
    keys = [key] if isinstance(key, str) else list(key)
    block = [F.col(f"{place}.file").alias("_file"), F.col(f"{place}.block").alias("_block")]
    inside = Window.partitionBy(*keys, "_file", "_block").orderBy(F.col(f"{place}.row"))
    rows = df.select("*", *block).withColumn("_in", F.row_number().over(inside))
    # the window's partitioning serves this count too; a key has one row per block
    blocks = rows.groupBy(*keys, "_file", "_block").agg(F.max("_in").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_file").alias("_f"), F.col("_block").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(blocks, same).select(*df.columns, (F.col("_in") + F.col("_before")).cast("long").alias(name))
