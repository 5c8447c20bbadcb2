"""Whole jobs (E1-E6), file loaders, the query registry with its DuckDB twins, plan checks."""
