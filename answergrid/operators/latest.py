"""The latest record of every entity of an append-only history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answergrid.functions import documents
from answergrid.functions.names import apart


def latest_per_entity(
    df: DataFrame,
    key: str = "entity_id",
    order: str = "loaded_at_utc",
    tie: str = "data",
    method: str = "window",
) -> DataFrame:
    """The row with the greatest ``order`` per ``key``; ``tie`` breaks ties.

    Both methods shuffle once, on ``key``, and reduce every partition to one
    row per entity before it, so an entity with very many rows stays cheap.
    ``window`` ranks the rows; ``aggregate`` keeps the greatest while grouping.
    """
    if method == "aggregate":
        others = [c for c in df.columns if c != key]
        best = F.max_by(F.struct(*others), F.struct(order, tie)).alias("__best")
        grouped = df.groupBy(key).agg(best)
        return grouped.select(*[key if c == key else f"__best.{c}" for c in df.columns])
    if method != "window":
        raise ValueError(f"unknown method: {method!r}")
    newest_first = Window.partitionBy(key).orderBy(
        F.col(order).desc_nulls_last(), F.col(tie).desc_nulls_last()
    )
    ranked = df.withColumn("__rank", F.row_number().over(newest_first))
    return ranked.where("__rank = 1").drop("__rank")


def project_fields(df: DataFrame, fields: Sequence[str], data: str = "data") -> DataFrame:
    """Fields of the JSON records as text columns of the same name.

    The other columns stay: a field whose name is taken gets its position.
    """
    others = [c for c in df.columns if c != data]
    parsed = df.withColumn("__record", documents.document_of(df, data))
    taken = {c.lower() for c in others}
    columns = [
        documents.field_text(F.col("__record"), f).alias(apart(f, i, taken)) for i, f in enumerate(fields)
    ]
    return parsed.select(*others, *columns)


def latest_fields(
    df: DataFrame,
    fields: Sequence[str],
    key: str = "entity_id",
    order: str = "loaded_at_utc",
    tie: str = "data",
) -> DataFrame:
    """The latest record per entity, its fields as columns."""
    return project_fields(latest_per_entity(df, key, order, tie), fields)
