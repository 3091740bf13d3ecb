"""Registered queries: name -> function of (spark, sf_dir), and their DuckDB oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "an_07"


def query(name: str, sql: str | None = None):
    """Registers a query under the survey's operator id, with its oracle if SQL can express it."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
