"""Query name -> callable, and the SQL that checks it."""

from __future__ import annotations

from .plans import dedup, extras, lifecycle, markers, readers, scalars, search, simple, streams, watchdogs

TABLE = {**search.QUERIES, **dedup.QUERIES, **markers.QUERIES, **watchdogs.QUERIES, **lifecycle.QUERIES, **scalars.QUERIES, **extras.QUERIES, **readers.QUERIES, **streams.QUERIES, **simple.QUERIES}


def queries() -> dict:
    return {name: run for name, (run, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items() if sql}
