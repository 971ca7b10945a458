"""Query registry: name to (Spark query, optional SQL oracle)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that must agree with it."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


MODULES = (
    "snapshots",
    "checks",
    "logs",
    "graphs",
    "reports",
    "pins",
    "lookups",
    "words",
    "streams",
    "files",
)


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"buildgraph.plans.{name}")
