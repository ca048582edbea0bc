"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrain.plans.bindings import Bindings, with_views

_QUERIES: dict[str, Callable[[Bindings], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(bindings)`` under ``name``, with the DuckDB form if there is one."""

    def put(fn: Callable[[Bindings], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return fn

    return put


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = _QUERIES[name]
    return lambda spark, sf_dir: fn(Bindings(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(name) for name in _QUERIES}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
