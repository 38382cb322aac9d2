"""Queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


from stewardry.queries import events, ingest, ledgers, reads, searches, state  # noqa: E402

flagship = reads.grid_orders_building
__all__ = ["ORACLES", "QUERIES", "events", "flagship", "ingest", "ledgers", "reads", "searches", "state"]
