"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Registers a function of the stand-in views; `views` names those that sql uses."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(views.split(), sql)
        return f

    return register


def with_views(names: list[str], sql: str) -> str:
    """sql after the definitions of the views it needs, in the order in which they build on each other."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in SQL_VIEWS[name][0].split():
            add(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in needed)
    return f"WITH {head} {sql}" if head else sql
