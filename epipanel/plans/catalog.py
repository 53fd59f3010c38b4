"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Common table expressions: name -> (names it builds on, SQL).
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    """Define a common table expression; ``{name}`` in SQL text is not expanded."""
    _CTES[name] = (needs, sql)


def with_ctes(body: str, *names: str, recursive: bool = False) -> str:
    """Put the named expressions, and all they need, in front of a SELECT."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1].strip()})" for n in ordered)
    # a recursive body starts with its own further expressions, after a comma
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body.strip()}"


def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query, with its SQL when SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *ctes, recursive=recursive)
        return fn

    return register
