"""How a part of the library registers its queries: a function and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import with_entities

Query = Callable[[SparkSession, str], DataFrame]


class Part:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.ORACLE_SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name; sql may name entities."""

        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.ORACLE_SQL[f.__name__] = with_entities(sql)
            return f

        return add
