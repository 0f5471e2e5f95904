"""Named queries over the test tables, each with its meaning in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from answergrid.functions.documents import configure
from answergrid.sources.tables import spread

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFunction
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a function as a query under its own name."""

    def register(function: QueryFunction) -> QueryFunction:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return function(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = Query(name, run, sql)
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are made into documents: costly rows, shared evenly."""
    return spread(table(spark, sf_dir, name))
