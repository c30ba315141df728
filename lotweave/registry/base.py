"""Registry of queries: a Spark callable and, where SQL can say it, the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotweave.registry.corpus import LISTINGS_SQL
from lotweave.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def truth(select: str, **ctes: str) -> str:
    """SQL over the listings the pages are written from (and further named subqueries)."""
    parts = [f"listings AS ({LISTINGS_SQL})"] + [f"{n} AS ({s})" for n, s in ctes.items()]
    return f"WITH {', '.join(parts)} {select}"
