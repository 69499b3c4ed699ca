"""Queries over the given tables, each beside the SQL that must give the same rows."""

from workloads import asking, deleting, indexing, intake, screening, searching, streams

GROUPS = [intake, screening, indexing, searching, asking, deleting, streams]


def all_queries():
    return {name: run for group in GROUPS for name, run in group.QUERIES.items()}


def all_sql():
    return {name: text for group in GROUPS for name, text in group.SQL.items()}
