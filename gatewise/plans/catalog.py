"""Registered queries: one per operator id of the inventory.

``register(name, sql)`` binds a query ``(spark, sf_dir) -> DataFrame`` to the
DuckDB statement that states the same result.  ``sql=None`` marks operators
that SQL cannot state (keyed greedy folds, JSON tree walks); the driver then
records a rows-only check and the test suite compares against a brute-force
fixture instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, bench)
        return fn

    return deco


def _load_all() -> None:
    # importing the modules fills REGISTRY
    from gatewise.plans import (  # noqa: F401
        q_requests,
        q_pii,
        q_masking,
        q_json,
        q_llm,
        q_quota,
        q_providers,
        q_canary,
        q_metrics,
        q_tables,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}
