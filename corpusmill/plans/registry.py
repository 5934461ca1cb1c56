"""All queries of the engine's own operators, by name, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from corpusmill.plans import anomaly, classify, dlp, events, graph, markdown, operations, relational, search, state, storage, text, vectors  # noqa: E402, F401
