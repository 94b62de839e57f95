"""A decorator that files a query and its SQL under a name."""

from __future__ import annotations


class Queries:
    def __init__(self, prefix: str = "base_"):
        self.prefix, self.queries, self.sql = prefix, {}, {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[self.prefix + f.__name__] = f
            if sql is not None:
                self.sql[self.prefix + f.__name__] = sql
            return f

        return register
