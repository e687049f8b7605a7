"""The named queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, with ``sql``, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def with_ctes(body: str, **ctes: str) -> str:
    return "with recursive " + ", ".join(f"{n} as ({s})" for n, s in ctes.items()) + " " + body
