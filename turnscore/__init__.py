"""turnscore: judge dialogue replies at scale with Spark DataFrames.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame, so Catalyst plans the whole job. Sub-packages:

* ``sources``   readers, writers, the dataset catalogue, driver-table adapters
* ``operators`` dialogue history, gold ratings, ranks, agreement, mining,
                submissions, retrieval, features, scoring, regression
* ``functions`` column expressions: prompts, reply parsing, ids, vectors, stats
* ``plans``     whole jobs (E1-E6) and plan checks
* ``streaming`` incremental scoring of arriving turns
"""

from turnscore.schemas import QUALITIES, DIAL_DIMENSIONS, TURN_DIMENSIONS  # noqa: F401

__all__ = ["QUALITIES", "TURN_DIMENSIONS", "DIAL_DIMENSIONS"]
