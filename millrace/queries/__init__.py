"""Registered queries with their SQL: each takes (spark, folder) and reads the given tables."""

from . import answers, corpus_loads, documents, ingest, scalars, search, streams

MODULES = (search, ingest, corpus_loads, scalars, answers, documents, streams)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: q for m in MODULES for name, q in m.SQL.items()}
