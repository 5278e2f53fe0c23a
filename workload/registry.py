"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed_views(sql: str) -> list[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in SQL_VIEWS.items():
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(body)
    return [name for name in SQL_VIEWS if name in found]


def with_views(sql: str) -> str:
    """Put the derived views a statement uses in front of it."""
    sql = sql.strip()
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in _needed_views(sql))
    if not views:
        return sql if sql[:6].upper() == "SELECT" else f"WITH {sql}"
    joiner = "\n" if sql[:6].upper() == "SELECT" else ",\n"
    return f"WITH {views}{joiner}{sql}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` starts with SELECT or with common table expressions."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
