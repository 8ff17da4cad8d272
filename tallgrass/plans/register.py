"""A decorator that files a query under its function's name, with its SQL where there is any."""

from __future__ import annotations


def catalogue() -> tuple[dict, dict, object]:
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return register

    return queries, sql, query
