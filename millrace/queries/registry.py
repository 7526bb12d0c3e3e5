"""A decorator that registers a query with its SQL."""

from __future__ import annotations


def register(queries: dict, sqls: dict):
    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return keep

    return query
