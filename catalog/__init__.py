"""Registered queries: every operator on the shared test tables, with its SQL."""

from __future__ import annotations

from catalog import (
    aggregates,
    basics,
    chemistry,
    flows,
    gaps,
    joining,
    statistics,
)

MODULES = (basics, chemistry, gaps, joining, aggregates, statistics, flows)


def all_queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
