"""Tables and queries as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: seconds a source query may take.
QUERY_SECONDS = 60


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Share the work of a few large splits among all cores.

    Parsing documents costs far more than reading them, so a file read by one
    task keeps one core busy for long.  A table that already has a split per
    core, as every large one has, is returned as it is, without a shuffle.
    Meant for tables as they are read: counting the splits of a query that
    shuffles would already run its first stages.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def read_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A query over the session's tables and any DataFrames named ``{name}``."""
    return spark.sql(sql, **tables)


def jdbc_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    query_seconds: int = QUERY_SECONDS,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Options for Spark's JDBC reader.

    With ``partition_column`` and its bounds the table is read in parallel
    ranges.  Without, one task reads it all, which suits small tables only.
    """
    options = {
        "url": url,
        "dbtable": table,
        "queryTimeout": str(query_seconds),
        "fetchsize": str(fetch_rows),
    }
    split = (partition_column, lower, upper, partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("partition_column, lower, upper and partitions go together")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table; see ``jdbc_options``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
