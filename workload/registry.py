"""Where queries register themselves, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def sql_text(template: str) -> str:
    """A template with ``{column}`` places as an SQL text expression."""
    pieces = re.split(r"\{(\w+)\}", template)
    quoted = ["'" + p.replace("'", "''") + "'" if i % 2 == 0 else f"CAST({p} AS VARCHAR)" for i, p in enumerate(pieces)]
    return " || ".join(q for q in quoted if q != "''") or "''"


def sql_rows(source: str, names: list[str], rows: list[tuple], where: dict[int, str] | None = None, key: str = "app") -> str:
    """SQL for ``rows`` of templates and numbers for every row of ``source``.

    ``where`` gives some rows a condition on the source row.
    """
    selects = []
    for i, row in enumerate(rows):
        values = [
            f"{sql_text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else v} AS {n}"
            for n, v in zip(names, row)
        ]
        condition = f" WHERE {where[i]}" if where and i in where else ""
        selects.append(f"SELECT {key}, {', '.join(values)} FROM {source}{condition}")
    return "\nUNION ALL ".join(selects)
