"""The append-only history: one fixed three-column table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The columns of a history table.
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("loaded_at_utc", T.TimestampType(), False),
    ]
)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class HistoryMismatch(ValueError):
    """The table exists with other columns."""


def _shape(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    return [(f.name, f.dataType) for f in schema]


def table_name(schema: str, table: str) -> str:
    for part in (schema, table):
        if not IDENTIFIER.fullmatch(part or ""):
            raise ValueError(f"not a table identifier: {part!r}")
    return f"`{schema}`.`{table}`"


def ensure_history(
    spark: SparkSession,
    schema: str,
    table: str,
    *,
    replace: bool = False,
    location: str | None = None,
) -> str:
    """Create the schema and the table if missing; returns the table's name.

    A table with other columns is an error.  It is dropped and made anew only
    with ``replace=True``.
    """
    name = table_name(schema, table)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    if spark.catalog.tableExists(name):
        if _shape(spark.table(name).schema) == _shape(HISTORY_SCHEMA):
            return name
        if not replace:
            raise HistoryMismatch(f"{name} does not have the columns of a history")
        spark.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()} NOT NULL" for f in HISTORY_SCHEMA)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet{place}")
    return name


def append_history(df: DataFrame, name: str) -> None:
    """Add rows to a history table; nothing is compared or replaced."""
    df.select(*HISTORY_SCHEMA.names).write.insertInto(name)


def append_history_files(df: DataFrame, path: str) -> None:
    """The same for a history kept as a folder of Parquet files."""
    df.select(*HISTORY_SCHEMA.names).write.mode("append").parquet(path)


def read_history_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)
