"""S4_dataset_catalogue: dataset name -> file template, annotation names,
annotator aggregation rule, and quality mapping (P7).

The catalogue is a handful of rows; it is exposed as DataFrames that are
broadcast by construction (size fixed by the tables below, never by data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's dataset catalogue).
# dataset -> (aggregation rule over annotator lists, annotation names)
# rule "mean": average of the list; rule "first": its first element.
# ---------------------------------------------------------------------------
DATASETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "convai2-grade": ("mean", ("relevance",)),
    "dailydialog-grade": ("mean", ("relevance",)),
    "dailydialog-gupta": ("first", ("overall",)),
    "dailydialog-predictive": ("mean", ("overall",)),
    "dailydialog-holistic": ("first", ("relevance",)),
    "dailydialog-zhao": ("mean", ("content", "grammar", "appropriateness", "relevance")),
    "dailydialog-zhao-hard": ("mean", ("content", "grammar", "appropriateness", "relevance")),
    "dailydialog-zhao-3": ("mean", ("content", "grammar", "appropriateness", "relevance")),
    "dstc7": ("mean", ("relevance", "informativeness", "overall")),
    "empathetic-grade": ("mean", ("relevance",)),
    "fed-turn": ("mean", ("Correct", "Engaging", "Fluent", "Interesting", "Overall", "Relevant",
                          "Semantically appropriate", "Specific", "Understandable")),
    "fed-turn-hard": ("mean", ("Correct", "Engaging", "Fluent", "Interesting", "Overall", "Relevant",
                               "Semantically appropriate", "Specific", "Understandable")),
    "fed-dial": ("mean", ("Coherent", "Error recovery", "Consistent", "Diverse", "Depth", "Likeable",
                          "Understanding", "Flexible", "Informative", "Inquisitive", "Overall")),
    "humod": ("mean", ("language_usage", "relevance")),
    "persona-see": ("first", ("avoid_rep", "enjoy", "fluency", "inquisitive", "interest", "listen",
                              "make_sense", "persona_guess", "turing")),
    "persona-see-hard": ("first", ("avoid_rep", "enjoy", "fluency", "inquisitive", "interest", "listen",
                                   "make_sense", "persona_guess", "turing")),
    "persona-usr": ("mean", ("Understandable", "Natural", "Maintains Context", "Engaging",
                             "Uses Knowledge", "Overall")),
    "persona-usr-hard": ("mean", ("Understandable", "Natural", "Maintains Context", "Engaging",
                                  "Uses Knowledge", "Overall")),
    "persona-zhao": ("mean", ("appropriateness",)),
    "rehearsal-copy-hard": ("mean", ("content", "grammar", "appropriateness", "relevance")),
    "rehearsal-constant-hard": ("mean", ("content", "grammar", "appropriateness", "relevance")),
    "rehearsal-omit-hard": ("mean", ("content", "grammar", "appropriateness", "relevance")),
    "topical-usr": ("mean", ("Understandable", "Natural", "Maintains Context", "Engaging",
                             "Uses Knowledge", "Overall")),
    "topical-usr-hard": ("mean", ("Understandable", "Natural", "Maintains Context", "Engaging",
                                  "Uses Knowledge", "Overall")),
}

# dataset -> quality -> source annotations (a source listed twice counts twice)
QUALITY_MAPPING: dict[str, dict[str, tuple[str, ...]]] = {
    "convai2-grade": {"relevance": ("relevance",)},
    "dailydialog-grade": {"relevance": ("relevance",)},
    "dailydialog-gupta": {"relevance": ("overall",)},
    "dailydialog-predictive": {},
    "dailydialog-holistic": {"relevance": ("relevance",)},
    "dailydialog-zhao": {"relevance": ("relevance",), "appropriateness": ("appropriateness",),
                         "richness": ("content",), "grammatical": ("grammar",)},
    "dailydialog-zhao-hard": {"relevance": ("relevance",), "appropriateness": ("appropriateness",),
                              "richness": ("content",), "grammatical": ("grammar",)},
    "dailydialog-zhao-3": {"relevance": ("relevance",), "appropriateness": ("appropriateness",),
                           "richness": ("content",), "grammatical": ("grammar",)},
    "dstc7": {"relevance": ("relevance",), "richness": ("informativeness",)},
    "empathetic-grade": {"relevance": ("relevance",)},
    "fed-turn": {"relevance": ("Relevant",), "appropriateness": ("Semantically appropriate", "Correct"),
                 "richness": ("Engaging", "Interesting", "Specific"),
                 "grammatical": ("Understandable", "Fluent")},
    "fed-turn-hard": {"relevance": ("Relevant",),
                      "appropriateness": ("Semantically appropriate", "Correct"),
                      "richness": ("Engaging", "Interesting", "Specific"),
                      "grammatical": ("Understandable", "Fluent")},
    "fed-dial": {},
    "humod": {"relevance": ("relevance",), "grammatical": ("language_usage",)},
    "persona-see": {"relevance": ("make_sense",), "appropriateness": ("listen", "make_sense"),
                    "richness": ("avoid_rep", "enjoy", "fluency", "enjoy", "inquisitive"),
                    "grammatical": ("fluency",)},
    "persona-see-hard": {"relevance": ("make_sense",), "appropriateness": ("listen", "make_sense"),
                         "richness": ("avoid_rep", "enjoy", "fluency", "enjoy", "inquisitive"),
                         "grammatical": ("fluency",)},
    "persona-usr": {"relevance": ("Understandable",),
                    "appropriateness": ("Maintains Context", "Uses Knowledge", "Understandable"),
                    "richness": ("Uses Knowledge", "Engaging"),
                    "grammatical": ("Natural", "Understandable")},
    "persona-usr-hard": {"relevance": ("Understandable",),
                         "appropriateness": ("Maintains Context", "Uses Knowledge", "Understandable"),
                         "richness": ("Uses Knowledge", "Engaging"),
                         "grammatical": ("Natural", "Understandable")},
    "persona-zhao": {"appropriateness": ("appropriateness",)},
    "rehearsal-copy-hard": {"relevance": ("relevance",), "appropriateness": ("appropriateness",),
                            "richness": ("content",), "grammatical": ("grammar",)},
    "rehearsal-constant-hard": {"relevance": ("relevance",), "appropriateness": ("appropriateness",),
                                "richness": ("content",), "grammatical": ("grammar",)},
    "rehearsal-omit-hard": {"relevance": ("relevance",), "appropriateness": ("appropriateness",),
                            "richness": ("content",), "grammatical": ("grammar",)},
    "topical-usr": {"relevance": ("Maintains Context", "Uses Knowledge"),
                    "richness": ("Natural", "Engaging"), "grammatical": ("Understandable",)},
    "topical-usr-hard": {"relevance": ("Maintains Context", "Uses Knowledge"),
                         "richness": ("Natural", "Engaging"), "grammatical": ("Understandable",)},
}

DATASET_TEMPLATE = "DSTC_11_Track_4/metadata/dev/en/{dataset}/{dataset}_eval_zh_es_pa.json"
HARD_TEMPLATE = "DSTC_11_Track_4/task2/hard-dev/{dataset}.json"
# ---------------------------------------------------------------------------

DATASET_NAMES = tuple(DATASETS)


def dataset_path(dataset: str, root: str = "") -> str:
    """``-hard`` datasets use their own template."""
    tpl = HARD_TEMPLATE if dataset.endswith("-hard") else DATASET_TEMPLATE
    return f"{root.rstrip('/')}/{tpl.format(dataset=dataset)}" if root else tpl.format(dataset=dataset)


def catalogue_rows() -> list[tuple]:
    """(dataset_idx, dataset, rule, annotation, position, n_annotations, path)"""
    rows = []
    for di, (name, (rule, anns)) in enumerate(DATASETS.items()):
        for pos, a in enumerate(anns):
            rows.append((di, name, rule, a, pos, len(anns), dataset_path(name)))
    return rows


def mapping_rows() -> list[tuple]:
    """(dataset, quality, source, weight): duplicates collapse into a weight."""
    rows = []
    for name, qmap in QUALITY_MAPPING.items():
        for quality, sources in qmap.items():
            seen: dict[str, int] = {}
            for s in sources:
                seen[s] = seen.get(s, 0) + 1
            for s, w in seen.items():
                rows.append((name, quality, s, w))
    return rows


CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("dataset_idx", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("annotation", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("n_annotations", T.IntegerType()),
        T.StructField("path", T.StringType()),
    ]
)
MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("weight", T.IntegerType()),
    ]
)


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per (dataset, annotation)."""
    return spark.createDataFrame(catalogue_rows(), CATALOGUE_SCHEMA)


def quality_mapping(spark: SparkSession) -> DataFrame:
    """One row per (dataset, quality, source) with the source's weight."""
    return spark.createDataFrame(mapping_rows(), MAPPING_SCHEMA)


def lookup(dataset: str) -> tuple[str, tuple[str, ...]]:
    """Resolve one dataset name; unknown names are an error."""
    if dataset not in DATASETS:
        raise KeyError(f"unknown dataset {dataset!r}")
    return DATASETS[dataset]


def sql_values(rows: list[tuple], columns: list[str]) -> str:
    """The same rows as a DuckDB ``(VALUES ...) t(cols)`` relation (oracle use)."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"
