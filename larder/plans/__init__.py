"""Queries on the driver's tables: bindings to the domain schemas, Spark plans and oracle SQL."""

import importlib

MODULES = [
    "stock_queries", "activity_queries", "text_queries", "matching_queries", "evaluation_queries", "io_queries",
    "stream_queries", "job_queries",
]


def load_catalog() -> tuple:
    """(queries, oracle SQL) of all query modules."""
    from larder.plans import registry

    for name in MODULES:
        importlib.import_module(f"larder.plans.{name}")
    return registry.QUERIES, registry.ORACLE
