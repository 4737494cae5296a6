"""All queries of the engine's own operators and their SQL, collected from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under a name, with its DuckDB counterpart if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in _RUNS:
            raise ValueError(f"query {name} is there already")
        _RUNS[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from quillon.plans import catalogue  # noqa: F401  registers on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
