"""Documents as rows or as wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergrid.functions import documents
from answergrid.functions.names import apart, field_names, free_names



def _others(df: DataFrame, col: str, made: Sequence[str]) -> tuple[list[str], list[str]]:
    """The columns that stay, all but the JSON column, and names apart from them for the new ones."""
    others = [c for c in df.columns if c.lower() != col.lower()]
    taken = {c.lower() for c in others}
    return others, [apart(name, i, taken) for i, name in enumerate(made)]


def unnest_rows(
    df: DataFrame, col: str, path: str = documents.ROOT, keys: Sequence[str] | None = None
) -> DataFrame:
    """One row per element of the array at ``path``, with its 0-based ``pos``.

    With ``keys`` every element gives one text column per key; otherwise the
    element itself is the text column ``value``.  Rows without an array give
    no rows.  The other columns are kept; a new one whose name is taken gets its
    place.  There is no shuffle.
    """
    doc = documents.document_of(df, col)
    made = ["value"] if keys is None else list(keys)
    others, (pos, *names) = _others(df, col, ["pos", *made])
    (one,) = free_names([*others, pos], "item")
    if keys is None:
        items = F.try_variant_get(doc, path, "array<variant>")
        cells = [F.col(one).cast("string").alias(names[0])]
    else:
        items = documents.records(doc, path, made)
        cells = [F.col(one)[k].alias(n) for k, n in zip(made, names, strict=True)]
    return df.select(*others, F.posexplode(items).alias(pos, one)).select(*others, pos, *cells)


def unnest_entries(df: DataFrame, col: str, path: str = documents.ROOT) -> DataFrame:
    """One row per entry of the object at ``path``: ``key`` and text ``value``."""
    entries = documents.object_map(documents.document_of(df, col), path)
    others, (key, value) = _others(df, col, ["key", "value"])
    (one,) = free_names([*others, key], "item")
    return df.select(*others, F.explode(entries).alias(key, one)).select(
        *others, key, F.col(one).cast("string").alias(value)
    )


def _with_items(df: DataFrame, col: str, keys: Sequence[str], path: str | None) -> tuple[DataFrame, str]:
    """The table with the documents' items in one more column, and its name."""
    doc, items = free_names(df.columns, "document", "items")
    parsed = df.withColumn(doc, documents.document_of(df, col))
    return parsed.withColumn(items, documents.item_records(F.col(doc), keys, path)).drop(doc), items


def _widths_allowed(n: int, what: str, most: int | None) -> None:
    if most is not None and n > most:
        raise ValueError(f"{n} or more {what} would make too many columns; name what you need")


def unnest_positional(
    df: DataFrame,
    col: str,
    name_key: str,
    value_key: str,
    max_items: int | None = None,
    *,
    path: str | None = None,
    prefix: str | None = None,
    most_columns: int | None = None,
) -> DataFrame:
    """Columns ``<col>_<name_key>_1, <col>_<value_key>_1, …_2, …`` per item.

    Items are the array at ``path``, else ``$.list``, the root array, or the
    root object alone.  Missing items are NULL.  Without ``max_items`` one more
    pass over the column finds the longest list: a single number.  With
    ``most_columns``, a list that would need more of them is then an error.  A new column
    whose name is taken gets its place.
    """
    prefix = prefix or col
    keys = [name_key, value_key]
    wide, items = _with_items(df, col, keys, path)
    if max_items is None:
        max_items = wide.agg(F.max(F.size(items))).first()[0] or 0
        _widths_allowed(2 * max_items, "cells per document", most_columns)
    columns: dict[str, Column] = {}
    taken = {c.lower() for c in df.columns}
    for i in range(max(max_items, 0)):
        record = F.get(F.col(items), F.lit(i))
        for key in keys:
            columns[apart(f"{prefix}_{key}_{i + 1}", i, taken)] = record[key]
    return wide.withColumns(columns).drop(items) if columns else wide.drop(items)


def distinct_names(
    df: DataFrame, col: str, name_key: str, *, path: str | None = None
) -> DataFrame:
    """Every item name that occurs in the column, once."""
    wide, items = _with_items(df.select(col), col, [name_key], path)
    names = documents.pluck(F.col(items), name_key, [name_key])
    return (
        wide.select(F.explode(names).alias("name"))
        .where("name IS NOT NULL")
        .distinct()
    )


def unnest_pivot(
    df: DataFrame,
    col: str,
    name_key: str,
    value_key: str,
    names: Sequence[str] | None = None,
    *,
    path: str | None = None,
    most_columns: int | None = None,
) -> DataFrame:
    """One column per item name, holding the value of the first such item.

    Names are compared whole.  The columns are filled row by row, without a
    shuffle.  Without ``names`` one more pass finds the distinct names; only
    those reach the driver; with ``most_columns``, more is an error.  ``distinct_names``
    has them as rows.  A column of ``df`` is never replaced.
    """
    if names is None:
        found = distinct_names(df, col, name_key, path=path)
        found = found if most_columns is None else found.limit(most_columns + 1)
        rows = found.orderBy("name").collect()
        names = [r["name"] for r in rows]
        _widths_allowed(len(names), "distinct names", most_columns)
    keys = [name_key, value_key]
    wide, items = _with_items(df, col, keys, path)
    made = field_names(names, df.columns)
    all_names, all_values = free_names([*wide.columns, *made], "names", "values")
    lists = wide.withColumns(
        {
            all_names: documents.pluck(F.col(items), name_key, keys),
            all_values: documents.pluck(F.col(items), value_key, keys),
        }
    )
    columns = {}
    for name, column in zip(names, made, strict=True):
        place = (F.array_position(all_names, F.lit(name)) - 1).cast("int")
        columns[column] = F.get(F.col(all_values), place)
    return lists.withColumns(columns).drop(items, all_names, all_values)
