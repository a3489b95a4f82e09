"""Registry of queries and of the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the derived views it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEW_SQL and name not in needed:
                visit(VIEW_SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query; the decorated function takes (spark, directory)."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return wrap
