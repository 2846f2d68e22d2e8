"""Where queries and their SQL are put together."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import oracle

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives its rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return put
