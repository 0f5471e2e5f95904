"""Query results as capped, all-text tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergrid.functions.documents import configure
from answergrid.functions.text import all_text, places

# Fixed value: the usual cap of an export; nothing is cut unless it is asked for.
ROW_CAP = 50_000

def capped(
    df: DataFrame,
    row_limit: int | None = None,
    *,
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """At most ``row_limit`` rows; all of them without a limit.

    With ``order``, the first rows in that order: every task keeps its first
    rows only.  Without, the rows are cut in the order that ``df`` already has,
    for which every partition sends up to the limit.
    """
    ordered = df if order is None else df.orderBy(*order)
    return ordered if row_limit is None else ordered.limit(row_limit)


def as_text(df: DataFrame) -> DataFrame:
    """Every value as cell text, NULL as an empty cell."""
    configure(df.sparkSession)
    return df.toDF(*places(df)).select(*all_text(df))


def header_of(df: DataFrame) -> list[str]:
    """The header row of an export, also when it has no rows."""
    return df.columns


def missing_by_day(
    df: DataFrame,
    time_col: str,
    field: str,
    days: int = 7,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """Per day of the last ``days``: all rows and those with an empty field.

    Newest day first: ``(date, total_responses, missing_values)``.
    """
    now = F.current_timestamp() if as_of is None else as_of
    now = now if isinstance(now, Column) else F.lit(now)
    recent = F.col(time_col) > now - F.make_dt_interval(days=F.lit(days))
    return (
        df.where(recent)
        .groupBy(F.to_date(time_col).alias("date"))
        .agg(
            F.count("*").alias("total_responses"),
            F.count_if(F.col(field) == "").alias("missing_values"),
        )
        .orderBy(F.col("date").desc())
    )
