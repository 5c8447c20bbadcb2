"""Import all registered query modules."""

from turnscore.plans import (  # noqa: F401
    q_aggs,
    q_gold,
    q_io,
    q_joins,
    q_models,
    q_retrieval,
    q_rows,
    q_text,
    q_windows,
)
