"""Where queries and their SQL meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaultframe.plans.proxies import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers a function of Views; ``select`` is the same result in SQL, if SQL has it."""
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if select is not None:
            ORACLES[name] = sql(select, ctes, recursive)
        return f

    return add
