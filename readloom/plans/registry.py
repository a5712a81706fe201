"""Queries of the operators, each with the DuckDB SQL that gives the same rows (where SQL can express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name; oracle is its SQL over the fixture views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            from .fixtures import with_views

            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add
