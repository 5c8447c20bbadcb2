"""Plan checks used by the tests: the physical plan of a job must not hold a
Cartesian product or nested-loop join, and row-level data must not be
funnelled into a single partition."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical_plan(df: DataFrame) -> str:
    """The (initial, pre-AQE) physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def plan_problems(df: DataFrame, allow_single_partition: bool = False) -> list[str]:
    plan = physical_plan(df)
    out = [op for op in FORBIDDEN if op in plan]
    if not allow_single_partition and "SinglePartition" in plan:
        out.append("SinglePartition")
    return out


def python_nodes(df: DataFrame) -> int:
    """Number of Python execution nodes (UDF / mapInPandas / mapInArrow) in the plan."""
    plan = physical_plan(df)
    return sum(plan.count(k) for k in ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"))
