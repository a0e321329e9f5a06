"""Named queries: a function of (spark, folder) and, beside it, the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.functions: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.functions[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
