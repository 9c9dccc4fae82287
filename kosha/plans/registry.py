"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """A name can be taken once."""

    def __init__(self) -> None:
        self.items: dict[str, object] = {}

    def add(self, name: str, item: object) -> None:
        if name in self.items:
            raise ValueError(f"{name} is registered already")
        self.items[name] = item

    def get(self, name: str) -> object:
        if name not in self.items:
            raise KeyError(f"{name} is not one of {sorted(self.items)}")
        return self.items[name]


_QUERIES, _SQL = Registry(), Registry()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES.add(f.__name__, f)
        if sql is not None:
            _SQL.add(f.__name__, sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES.items)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL.items)
