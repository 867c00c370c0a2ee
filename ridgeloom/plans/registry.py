"""The named queries of the library and the DuckDB SQL that each is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries.
MODULES = ("catalog", "tagging", "terrain", "walks", "offers", "formats", "journeys", "searching", "extracting", "touring", "reaching")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its oracle where SQL can express it."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"ridgeloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
