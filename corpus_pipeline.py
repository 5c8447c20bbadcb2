"""A training-data pipeline over ``documents``.

Language identification, line dedup, n-gram Jaccard join, benchmark
decontamination, BPE encoding: each stage takes what its predecessor kept,
written as Parquet and read again. All stages but the last return the columns
of ``documents``; a stage that changes ``text`` sets ``n_chars`` anew.

Cases, beyond those of the operators: a null text is ``und`` and goes in the
first stage; rows that share a doc_id stand for one document and stay or go
together; a row without doc_id can't be named by a group and stays; a document
left without text by a later stage stays as an empty one; an empty table gives
empty results; extra columns are carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscore.llm import bpe, decontamination, language_id, line_templates, ngram_join
from turnscore.llm.queries import table, tokenizer_path
from turnscore.session import reliable_checkpoint, ship_package

#: Share of a recognised document's 4-grams that one language's training texts hold, at least, beyond chance; less
#: where the training texts know each other less (``Model.usual``). The score can't tell: a text's language values add
#: up to 1 whatever the text.
LEAST_KNOWN = 0.7
#: Near copies: words of a shingle and least similarity.
SHINGLE, SIMILARITY = 5, (80, 100)


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input, ``n_chars`` (where there is one) counted anew."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or that no language explains."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    named = language_id.classify(docs, model, docs.columns, known=True).toDF(*docs.columns, "_lang_pred", "_score", "_known")
    kept = named.where((F.col("_lang_pred") != language_id.UNDETERMINED) & (F.col("_known") >= min(LEAST_KNOWN, model.usual)))
    return kept.drop("_lang_pred", "_score", "_known")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template recurs across documents."""
    return _with_text(line_templates.drop_recurring_lines(docs), docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies."""
    groups = ngram_join.jaccard_components(docs, ["doc_id"], shingle=SHINGLE, t=SIMILARITY)
    gone = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("names")).where("not names").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts."""
    others = [c for c in docs.columns if c != "text"]
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), others)
    return _with_text(found.withColumnRenamed("clean_text", "text"), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts: doc_id, lang, source, n_tokens, ids."""
    return bpe.encode(docs, tokenizer_path(), ["doc_id", "lang", "source"]).drop("decoded")


STAGES = [
    ("language_id", keep_recognised),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", keep_representatives),
    ("benchmark_decontamination", remove_benchmark),
    ("bpe_encoding", encode),
]

#: Classifier, templates and token merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the ``documents`` of a folder."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
