"""The library's registered queries: name -> (function, SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.store import ship

_ENTRIES: dict[str, tuple[Callable, str | None]] = {}
MODULES = ("audits", "reports", "ledgers", "texts", "review")


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its own name, with the SQL for the same rows."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        _ENTRIES[fn.__name__] = (run, sql)
        return run

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def queries() -> dict:
    _load()
    return {k: f for k, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _ENTRIES.items() if sql}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return queries()["naming_drift"](spark, sf_dir)
