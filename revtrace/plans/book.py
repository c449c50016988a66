"""A small book of queries: name, callable, SQL."""
from __future__ import annotations


class Book:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return wrap
