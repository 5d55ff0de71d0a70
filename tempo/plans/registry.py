"""Registered queries of the panel engine, by name."""

from __future__ import annotations

from tempo.plans import evaluation_queries, panel_queries

_ALL = {**panel_queries.QUERIES, **evaluation_queries.QUERIES}


def queries():
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
