"""Registry of checked queries: a Spark callable and, where SQL can say it, DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


class Checks:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                ship(spark)
                return fn(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def rd(name: str, digits: int = 6) -> Column:
    """Rounded output column of the same name."""
    return F.round(F.col(name), digits).alias(name)


def rds(*names: str, digits: int = 6) -> list[Column]:
    return [rd(n, digits) for n in names]


def sql_rd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
