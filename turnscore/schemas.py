"""Explicit schemas and quality constants.

Missing ratings are NULL everywhere inside the engine (NaN is converted once,
at load, by :func:`turnscore.sources.io.nan_to_null`).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (quality names and the grading
# dimensions of the challenge files, in the reference's order).
# ---------------------------------------------------------------------------
QUALITIES = ("appropriateness", "richness", "grammatical", "relevance")
TURN_DIMENSIONS = (
    "APPROPRIATENESS",
    "CONTENT_RICHNESS",
    "GRAMMATICAL_CORRECTNESS",
    "RELEVANCE",
)
DIAL_DIMENSIONS = ("COHERENCE", "ENGAGENESS", "INFORMATIVENESS", "OVERALL")
# challenge column -> quality name (turn gold file and submission file)
DIMENSION_TO_QUALITY = {
    "APPROPRIATENESS": "appropriateness",
    "CONTENT_RICHNESS": "richness",
    "GRAMMATICAL_CORRECTNESS": "grammatical",
    "RELEVANCE": "relevance",
}
# gold annotation name in rehearsal / hard sets -> predicted quality name
GOLD_TO_PREDICTED = {
    "relevance": "relevance",
    "appropriateness": "appropriateness",
    "content": "richness",
    "grammar": "grammatical",
}
DEFAULT_MISSING_SCORE = 3.0
SUBMISSION_ROWS = 1790
HARD_SET_SIZE = 200
# ---------------------------------------------------------------------------

SUBTASK_DIMENSIONS = {
    "t1t": TURN_DIMENSIONS,
    "t2t": TURN_DIMENSIONS,
    "t1d": DIAL_DIMENSIONS,
    "t2d": DIAL_DIMENSIONS,
}

RATINGS = T.ArrayType(T.DoubleType())
EMBEDDING = T.ArrayType(T.FloatType())

REHEARSAL_INPUT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sid", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
    + [T.StructField(f"p_{q}", T.DoubleType()) for q in ("appr", "cont", "gram", "rel")]
    + [T.StructField(f"o_{q}", T.DoubleType()) for q in ("appr", "cont", "gram", "rel")]
)


def dialogue_schema(annotations: list[str] | tuple[str, ...]) -> T.StructType:
    """Schema of one dialogue dataset file; ``annotations`` nested as a struct
    of rating lists (one list entry per annotator)."""
    text = [
        "dialogue_id",
        "model",
        "context",
        "response",
        "context_zh",
        "context_es",
        "context_pa",
        "response_zh",
        "response_es",
        "response_pa",
    ]
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in text]
        + [
            T.StructField(
                "annotations",
                T.StructType([T.StructField(a, RATINGS) for a in annotations]),
            )
        ]
    )

