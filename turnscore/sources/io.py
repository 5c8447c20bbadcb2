"""Readers and writers: S1, S2, S3, S5, S6, S7, S8, S9.

Formats and options follow SURVEY trap K7 (CSV round trip with quotes,
newlines, empty strings and NULLs). Result tables are Parquet partitioned by
``run_id`` and version, so reading one run is partition pruning, not a glob; a
run's version is published by its manifest (:func:`publish`).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscore.operators.identity import with_place

CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "\\N"}


def json_layout(spark: SparkSession, path: str) -> str:
    """``array`` (each file one JSON array or one record over several lines) or
    ``lines`` (one record per line), judged by the first line of every file;
    an error where the files differ. Only the head of each file is read."""
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # lists, reads nothing
    kinds = {k for f in files if (k := _layout_of(spark, f))}
    if len(kinds) > 1:
        raise ValueError(f"{path} mixes JSON arrays and JSON lines")
    return kinds.pop() if kinds else "lines"


def _layout_of(spark: SparkSession, file: str, size: int = 1 << 16) -> str | None:
    """The layout that a file's first line that isn't blank shows; None if there is none."""
    while True:
        head, ended = _head(spark, file, size)
        text = head.lstrip()
        if not text:
            if ended:
                return None
        elif not text.startswith("{"):
            return "array"
        elif "\n" in text or ended:
            return "lines" if text.split("\n", 1)[0].rstrip().endswith("}") else "array"
        size *= 8  # a long first line, or many blank ones


def _head(spark: SparkSession, file: str, size: int) -> tuple[str, bool]:
    """The first ``size`` bytes of a (possibly compressed) file as text, and whether that is all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = _files(spark, file).open(_path(spark, file))
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(_path(spark, file))
        source = codec.createInputStream(stream) if codec else stream
        raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(source, size)))
    finally:
        stream.close()
    return raw.decode("utf-8-sig", "ignore"), len(raw) < size


def read_dialogue_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool | None = None,
                       place: bool = False) -> DataFrame:
    """One dataset. ``multiline`` true: JSON arrays (the challenge format;
    one task per file, convert once to Parquet); false: JSON lines
    (splittable); by default the files tell (:func:`json_layout`). A file of
    the other layout fails instead of losing records. Nested ``annotations``
    stay a struct of lists; NaN becomes NULL. ``place``: also each row's place
    in the files (:mod:`turnscore.operators.identity`)."""
    layout = json_layout(spark, path)
    if multiline is None:
        multiline = layout == "array"
    elif multiline != (layout == "array"):
        raise ValueError(f"{path} holds JSON {layout}, but multiline={multiline} was asked for")
    rows = spark.read.schema(schema).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    return nan_to_null(with_place(rows, "json") if place else rows)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in a double column, or in lists of doubles (of a struct too), as
    NULL: a reader's values are missing or real numbers."""

    def fixed(c, t):
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), c)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.DoubleType, T.FloatType)):
            return F.transform(c, lambda x: F.when(~F.isnan(x), x))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fixed(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return c

    return df.select(*[fixed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def flatten_annotations(df: DataFrame, struct_col: str = "annotations") -> DataFrame:
    """Long annotator lists ``(.., annotation, ratings)`` from the nested struct."""
    fields = df.schema[struct_col].dataType.fieldNames()
    arr = F.array(*[F.struct(F.lit(f).alias("annotation"), F.col(struct_col)[f].alias("ratings")) for f in fields])
    keep = [c for c in df.columns if c != struct_col]
    return df.select(*keep, F.inline(arr))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, quoted fields that may hold newlines, explicit
    schema (no inference)."""
    r = spark.read.schema(schema).option("multiLine", "true")
    for k, v in CSV_OPTIONS.items():
        r = r.option(k, v)
    return nan_to_null(r.csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with every field quoted (Spark's nearest to "quote
    non-numeric"), round-trippable by :func:`read_csv`."""
    w = df.write.mode(mode).option("quoteAll", "true")
    for k, v in CSV_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)


def nest_annotations(df: DataFrame, annotation_cols: Sequence[str], struct_col: str = "annotations") -> DataFrame:
    """S6 core: fold flat annotation columns into a nested struct, each value
    wrapped in a one-element list."""
    nested = F.struct(*[F.array(F.col(c).cast("double")).alias(c) for c in annotation_cols])
    keep = [c for c in df.columns if c not in annotation_cols]
    return df.select(*keep, nested.alias(struct_col))


#: Translated texts that a dataset file has a column for even where there are none.
TRANSLATIONS = ("context_zh", "context_es", "context_pa", "response_zh", "response_es", "response_pa")


def write_nested_json(df: DataFrame, path: str, annotation_cols: Sequence[str], mode: str = "overwrite") -> None:
    """Write the nested records as JSON lines (one file per task), with
    empty texts for the translations that ``df`` lacks, so any variant loads."""
    nested = nest_annotations(df, annotation_cols)
    lacking = {c: F.lit("") for c in TRANSLATIONS if c not in nested.columns}
    nested.withColumns(lacking).write.mode(mode).json(path)


#: Names of the partition columns that are text whatever they look like.
_TEXT_KEYS = ("run_id", "split", "version")


def _read_partitioned(spark: SparkSession, root: str) -> DataFrame:
    """A partitioned table with its partition values as the strings they are:
    inferred types would make one run of ``007`` and ``7``."""
    schema = spark.read.parquet(root).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in _TEXT_KEYS else f for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(root)


def publish(df: DataFrame, root: str, key: dict[str, str | int]) -> str:
    """Replace the part ``key`` (such as one run, or one run's split) of the
    table at ``root`` by ``df``, all at once.

    The rows are written beside what is there, as a version of their own; then
    one small file, the part's manifest, is replaced by a rename. Readers resolve
    manifests, so during a re-run they see the old rows or the new ones, never a
    mix, and rows of a failed write are never seen. The version before stays for
    readers that have resolved it already; older ones are removed."""
    spark = df.sparkSession
    version = uuid.uuid4().hex[:12]
    df.withColumns({**{k: F.lit(v) for k, v in key.items()}, "version": F.lit(version)}).write.mode("append").partitionBy(*key, "version").parquet(root)
    folder, manifest = _manifest(root, key)
    before = _read_text(spark, f"{folder}/{manifest}").split()
    _put_text(spark, folder, manifest, " ".join([version, *before[:1]]))
    if all(re.fullmatch(r"[A-Za-z0-9._-]+", str(v)) for v in key.values()):
        for old in before[1:]:
            _files(spark, old_path := "/".join([root, *[f"{k}={v}" for k, v in key.items()], f"version={old}"])).delete(_path(spark, old_path), True)
    return version


def _manifest(root: str, key: dict) -> tuple[str, str]:
    """Folder (of the run) and name of a part's manifest; Spark doesn't read names that begin with ``_``."""
    names = [f"{k}={quote(str(v), safe='')}" for k, v in key.items()]
    return f"{root.rstrip('/')}/_published/{names[0]}", "&".join(names[1:]) or "all"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _files(spark, path), _path(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    jvm, fs = spark.sparkContext._jvm, _files(spark, folder)
    staged, final = (_path(spark, f"{folder}/{n}") for n in (f".{uuid.uuid4().hex}", name))
    stream = fs.create(staged, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(final), how)


def _versions(spark: SparkSession, root: str, run_id: str, part: str | None = None) -> list[str]:
    """Published versions of a run (of one of its parts)."""
    folder, _ = _manifest(root, {"run_id": run_id})
    fs = _files(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    found = [_read_text(spark, f"{folder}/{n}").split()[:1] for n in names if not n.startswith(".") and (part is None or n == part)]
    return [v for vs in found for v in vs]


def read_published(spark: SparkSession, root: str, run_id: str, part: str | None = None) -> DataFrame:
    """A run's rows as published (partition pruning on run and version)."""
    chosen = (F.col("run_id") == run_id) & F.col("version").isin(_versions(spark, root, run_id, part))
    return _read_partitioned(spark, root).where(chosen).drop("version")


def read_all_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs' rows as published. The versions, one per run and part, are a
    small table that the planner may broadcast."""
    folder = f"{root.rstrip('/')}/_published"
    runs = [s.getPath().getName() for s in _files(spark, folder).listStatus(_path(spark, folder))]
    versions = [(v,) for r in runs for v in _versions(spark, root, unquote(r.split("=", 1)[1]))]
    return _read_partitioned(spark, root).join(spark.createDataFrame(versions, "version string"), "version", "left_semi").drop("version")


def write_results(df: DataFrame, root: str, run_id: str, part: dict[str, str | int] | None = None) -> None:
    """S9 (and the run-result side of S3): publish a scored table as run
    ``run_id`` of the results table (:func:`publish`: that run's earlier rows are
    replaced at once, other runs are untouched). ``part``: only a part of the
    run, such as a streaming epoch."""
    publish(df, root, {"run_id": run_id, **(part or {})})


def read_results(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """S3: a run's result table by id, as published last."""
    return read_published(spark, root, run_id)


def write_embeddings(df: DataFrame, root: str, run_id: str, split: str) -> None:
    """Publish embedding records (``ARRAY<FLOAT>``) as a run's split."""
    publish(df, root, {"run_id": run_id, "split": split})


def read_embeddings(spark: SparkSession, root: str, run_id: str, split: str) -> DataFrame:
    return read_published(spark, root, run_id, _manifest(root, {"run_id": run_id, "split": split})[1]).where(F.col("split") == split)


RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("args_json", T.StringType()),
    ]
)


def append_run(spark: SparkSession, root: str, run_id: str, prompt: str, model_name: str, seed: int,
               **options) -> None:
    """Publish one run record (all options as JSON): recording the same run
    again replaces its record."""
    row = (run_id, prompt, model_name, int(seed), json.dumps(options, sort_keys=True))
    publish(spark.createDataFrame([row], RUN_SCHEMA).drop("run_id"), root, {"run_id": run_id})


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All run records (``run_id`` comes from the partition folders)."""
    return read_all_runs(spark, root).select(*RUN_SCHEMA.fieldNames())
