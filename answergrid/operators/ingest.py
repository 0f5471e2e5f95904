"""Raw cell grids as history records.

A grid has a column ``cells`` (an array of texts, as long as its row) and a
column ``row_no`` of any type that orders the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.functions.text import strip


class HeaderNotFound(ValueError):
    """No row of the grid holds the id field."""


def row_literal(value: Any, dtype: T.DataType) -> Column:
    """A ``row_no`` as a literal to compare rows with."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[row_literal(value[f.name], f.dataType).alias(f.name) for f in dtype])
    return F.lit(value).cast(dtype)


@dataclass(frozen=True)
class Header:
    """Where the header is and which column holds which field.

    Without a ``row_no`` the header lies above all rows.
    """

    row_no: Any
    columns: dict[str, int]
    missing: list[str] = field(default_factory=list)


def holds(field: str) -> Column:
    """Whether a row has a cell with this name, whatever its case and padding."""
    names = F.transform("cells", lambda c: F.lower(strip(c)))
    return F.array_contains(names, F.lower(F.lit(field)))


def find_header(grid: DataFrame, id_field: str, fields: Sequence[str]) -> Header:
    """The first row that holds ``id_field``, whatever its case and padding.

    A field takes the first column with its name.  One pass over the grid finds
    the row; only the positions in this one row reach the driver.
    """
    wanted = list(dict.fromkeys([id_field, *fields]))
    names = F.transform("cells", lambda c: F.lower(strip(c)))
    places = [
        F.array_position("names", F.lower(F.lit(f))).alias(f"p{i}") for i, f in enumerate(wanted)
    ]
    candidates = (
        grid.where(holds(id_field))
        .select("row_no", names.alias("names"))
        .select(F.struct("row_no", *places).alias("header"))
    )
    row = candidates.agg(F.min_by("header", "header.row_no").alias("header")).first()["header"]
    if row is None:
        raise HeaderNotFound(f"no header row holds the id field {id_field!r}")
    found = {f: row[f"p{i}"] for i, f in enumerate(wanted)}
    return Header(
        row_no=row["row_no"],
        columns={f: p - 1 for f, p in found.items() if p},
        missing=[f for f, p in found.items() if not p],
    )


def _cell(position: int | None) -> Column:
    """A stripped cell; empty for a short row or a missing field."""
    if position is None:
        return F.lit("")
    return F.coalesce(strip(F.get(F.col("cells"), F.lit(position))), F.lit(""))


def _is_header(header: Header) -> Column:
    """Whether a row has every field's name where the header has it."""
    tests = [F.lower(_cell(p)) == F.lower(F.lit(f)) for f, p in header.columns.items()]
    return reduce(and_, tests)


def pack_rows(
    grid: DataFrame,
    header: Header,
    id_field: str,
    fields: Sequence[str],
    *,
    rename: Mapping[str, str] | None = None,
    loaded_at: datetime | Column | None = None,
    repeated_headers: bool = False,
) -> DataFrame:
    """``(entity_id, data, loaded_at_utc)`` of the rows below the header.

    ``data`` is a JSON object of the fields in the caller's spelling and order,
    or under the names in ``rename``; two fields under one name are an error.
    Blank rows and blank ids are skipped.
    With ``repeated_headers`` so are rows that repeat the header, as grids of
    many files have them.
    All rows of one load share one time; one without a zone is UTC.  Needs no shuffle and runs on streams.
    """
    names = rename or {}
    renamed = [names.get(f, f) for f in dict.fromkeys(fields)]
    if len(set(renamed)) < len(renamed):
        raise ValueError(f"several fields would get one name: {sorted(renamed)}")
    cells = {names.get(f, f): _cell(header.columns.get(f)) for f in fields}
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    if isinstance(stamp, datetime):
        aware = stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc)
        stamp = F.lit(aware)
    filled = F.exists("cells", lambda c: strip(c) != "")
    if header.row_no is not None:
        filled &= F.col("row_no") > row_literal(header.row_no, grid.schema["row_no"].dataType)
    if repeated_headers:
        filled &= ~_is_header(header)
    return (
        grid.where(filled)
        .select(
            _cell(header.columns[id_field]).alias("entity_id"),
            F.to_json(F.struct(*[c.alias(n) for n, c in cells.items()])).alias("data"),
            stamp.cast("timestamp").alias("loaded_at_utc"),
        )
        .where("entity_id <> ''")
    )


def import_grid(
    grid: DataFrame, id_field: str, fields: Sequence[str], **packing
) -> tuple[DataFrame, Header]:
    """Find the header and pack the rows; the header lists missing fields.

    ``packing`` are the options of ``pack_rows``.
    """
    header = find_header(grid, id_field, fields)
    return pack_rows(grid, header, id_field, fields, **packing), header
