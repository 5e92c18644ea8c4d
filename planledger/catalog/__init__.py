"""Registered queries with the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from . import advice, corpus, metadata, params, paths, plans, source, statements

_MODULES = (corpus, source, statements, metadata, paths, params, plans, advice)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
