"""Registration of queries with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from cairnflow.sources.tables import table

#: All ages and recencies are relative to this moment; nothing reads the clock.
AS_OF = "2026-06-01 00:00:00"


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Registers ``f(t)``, where ``t(name)`` is a table, under its own name."""

        def add(f):
            key = name or f.__name__
            assert key not in self.QUERIES, key
            self.QUERIES[key] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
            if sql:
                self.SQL[key] = sql.replace("{AS_OF}", f"TIMESTAMP '{AS_OF}'")
            return f

        return add
