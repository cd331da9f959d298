"""The named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkshelf.plans.derived import Tables
from linkshelf.plans.sqltext import with_derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL statement."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_derived(sql)
        return fn

    return add


def load_all() -> None:
    """Import every query module once."""
    from linkshelf.plans import flows, gates, library, links, reruns, speech, texts  # noqa: F401
