"""Names of all queries of the library, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook import tables
from tidebook.plans import accounts, books, dated, market, queues, relational, reports, scalars, soak, streams, validation, wire

#: Modules of queries with oracles in other terms; they come before a plain text of the same name.
MODULES = (market, scalars, books, reports, validation, streams, accounts, wire, dated, queues, soak)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, d, text=text: tables.query(spark, d, text)) for name, text in relational.SQL.items()}
    for module in MODULES:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: tables.duck(text) for name, text in relational.SQL.items()}
    for module in MODULES:
        for name in module.queries():
            found.pop(name, None)
        found |= {name: tables.duck(text) for name, text in module.ORACLES.items()}
    return found
