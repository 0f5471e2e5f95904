"""Text grids in files: CSV without a schema, every cell a text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.operators.export import as_text, capped
from answergrid.operators.ingest import (
    Header,
    HeaderNotFound,
    find_header,
    holds,
    import_grid,
    pack_rows,
)
from answergrid.sources.records import Records, lines_of, width_of

# Fixed value: rows of one written batch, for those who ask for batches.
BATCH_ROWS = 10_000
#: So many files are counted in one job, at most, where a range looks for its rows.
COUNTED_FILES = 1024

_QUOTED = {"quote": '"', "escape": '"'}


@dataclass(frozen=True)
class CellRange:
    """Columns and rows of a range, counted from 0, ends excluded."""

    first_column: int = 0
    end_column: int | None = None
    first_row: int = 0
    end_row: int | None = None


def _column_number(letters: str) -> int:
    number = 0
    for letter in letters.upper():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


def parse_range(text: str) -> CellRange:
    """``A1:F100``, ``A:F`` or ``B2``, with or without ``Name!`` before it."""
    cells = text.rsplit("!", 1)[-1].replace("$", "")
    corner = r"([A-Za-z]{1,3})([1-9]\d*)?"
    found = re.fullmatch(rf"{corner}(?::{corner})?", cells)
    if not found:
        raise ValueError(f"not a cell range: {text!r}")
    left, top, right, bottom = found.groups()
    if right is None:
        right, bottom = left, top
    return CellRange(
        _column_number(left) - 1,
        _column_number(right),
        int(top) - 1 if top else 0,
        int(bottom) if bottom else None,
    )


@dataclass(frozen=True)
class _Files:
    """Files of records: which there are, and their records as they are read."""

    spark: SparkSession
    path: str | list[str]
    sep: str

    def listed(self) -> DataFrame:
        """The names of the files, from their listing: no content is read."""
        files = self.spark.read.format("binaryFile").load(self.path)
        return files.select(F.col("_metadata.file_path").alias("file"))

    def records(self, *tests: Column) -> Records:
        """``tests`` of ``file`` leave out whole files."""
        return Records(reduce(DataFrame.where, tests, lines_of(self.spark, self.path)), self.sep)

    def rows(self, numbered: bool, *tests: Column) -> DataFrame:
        """``file, number, value``; where numbers are not asked for and no line has a quote, lines are records."""
        records = self.records(*tests)
        if numbered or not records.lines.where(F.contains("value", F.lit('"'))).isEmpty():
            return records.rows
        return records.lines.select("file", F.lit(None).cast("long").alias("number"), F.regexp_replace("value", r"\r\z", "").alias("value"))

    def holding(self, n: int) -> tuple[str, int] | None:
        """The file that holds the n-th record, and which of its records that is.

        Files are counted in their order, some at a time, up to that file only.
        """
        step, last = 1, None
        while True:
            left = self.listed() if last is None else self.listed().where(F.col("file") > last)
            batch = [r["file"] for r in left.orderBy("file").limit(step).collect()]
            if not batch:
                return None
            counts = self.records(F.col("file").between(batch[0], batch[-1])).counts()
            for file in batch:
                if n <= counts.get(file, 0):
                    return file, n
                n -= counts.get(file, 0)
            step, last = min(2 * step, COUNTED_FILES), batch[-1]


def _csv(sep: str, width: int) -> dict[str, str]:
    return {"sep": sep, **_QUOTED, "maxColumns": str(max(width + 1, 20480))}


def _rows_in(files: _Files, area: CellRange, numbered: bool, *tests: Column) -> DataFrame:
    """The records of a range; files beyond its borders are not read."""
    first = files.holding(area.first_row + 1) if area.first_row else None
    last = files.holding(area.end_row) if area.end_row else None
    if area.first_row and first is None:
        tests = (*tests, F.lit(False))
    if first:
        tests = (*tests, F.col("file") >= first[0])
    if last:
        tests = (*tests, F.col("file") <= last[0])
    rows = files.rows(numbered or bool(first or last), *tests)
    place = lambda border: F.struct(F.lit(border[0]).alias("file"), F.lit(border[1] - 1).cast("long").alias("number"))
    if first:
        rows = rows.where(F.struct("file", "number") >= place(first))
    if last:
        rows = rows.where(F.struct("file", "number") <= place(last))
    return rows


def _cells(rows: DataFrame, width: int, sep: str) -> DataFrame:
    """The records in ``value`` as structs of ``width`` texts in ``row``."""
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    parsed = F.from_csv("value", schema, {**_csv(sep, width), "multiLine": "true"})
    # A generator of one row, so that no filter on cells parses a record again.
    return rows.select("file", "number", F.explode_outer(F.array(parsed)).alias("row"))


def _read(
    spark: SparkSession,
    path: str | list[str],
    cell_range: str | None,
    width: int | None,
    sep: str,
    numbered: bool,
    *tests: Column,
) -> DataFrame:
    area = parse_range(cell_range) if cell_range else CellRange()
    rows = _rows_in(_Files(spark, path, sep), area, numbered, *tests)
    if width is None and area.end_column is None:
        width = width_of(rows, sep)
    width = min(w for w in (area.end_column, width) if w)
    cells = [F.col("row")[f"c{i}"] for i in range(area.first_column, width)]
    return _cells(rows, width, sep).select(
        F.struct("file", "number").alias("row_no"),
        (F.array(*cells) if cells else F.array().cast("array<string>")).alias("cells"),
    )


def read_grid(
    spark: SparkSession,
    path: str | list[str],
    *,
    cell_range: str | None = None,
    width: int | None = None,
    sep: str = ",",
) -> DataFrame:
    """``(row_no, cells)`` of grid files.

    ``row_no`` is the file and the number of the record in it, from 0: it depends on the
    files alone, not on how Spark shares them out.  Large files are split among tasks, also
    where cells hold line breaks (see ``records``): every split is read once to find where
    records begin, and once for the rows.

    Rows may be ragged: missing cells are NULL, cells beyond the width are left
    out.  The width is the lesser of the range's and ``width``, which one more
    pass over the rows finds where neither is given.  A range with rows reads files
    in order, up to the one where it ends.
    """
    return _read(spark, path, cell_range, width, sep, True)


def import_files(
    spark: SparkSession,
    path: str | list[str],
    id_field: str,
    fields: list[str],
    *,
    cell_range: str | None = None,
    width: int | None = None,
    sep: str = ",",
    **packing,
) -> tuple[DataFrame, Header]:
    """Find the header of grid files and pack the rows below it.

    The header is nearly always in the first file, so that file is searched
    first; otherwise one pass finds the file that has it.  Only this file's rows
    are numbered.  All later files are read once more, twice where cells are quoted,
    and only as far as the last column that holds a wanted field.  A range with rows
    is read by ``read_grid``.

    ``packing`` are the options of ``pack_rows``; what ``write_grid`` wrote has
    ``repeated_headers``.
    """
    area = parse_range(cell_range) if cell_range else CellRange()
    how = (cell_range, width, sep)
    if area.first_row or area.end_row:
        return import_grid(_read(spark, path, *how, True), id_field, fields, **packing)
    file = _Files(spark, path, sep).listed().agg(F.min("file")).first()[0]
    head = _read(spark, path, *how, True, F.col("file") == file)
    try:
        header = find_header(head, id_field, fields)
    except HeaderNotFound:
        later = _read(spark, path, *how, False, F.col("file") > file)
        file = later.where(holds(id_field)).agg(F.min("row_no.file")).first()[0]
        head = _read(spark, path, *how, True, F.col("file") == file)
        header = find_header(head, id_field, fields)
    used = area.first_column + max(header.columns.values()) + 1
    rest = _read(spark, path, cell_range, used, sep, False, F.col("file") > file)
    packed = pack_rows(head, header, id_field, fields, **packing).unionByName(
        pack_rows(rest, replace(header, row_no=None), id_field, fields, **packing)
    )
    return packed, header


def write_grid(
    df: DataFrame,
    path: str,
    *,
    include_headers: bool = True,
    row_limit: int | None = None,
    order: Sequence[Column | str] | None = None,
    batch_rows: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write a query result as text, replacing what was there.

    ``row_limit`` and ``order`` are those of ``capped``.  Tasks write in parallel,
    one file each, or files of at most ``batch_rows`` rows.  Every file has the
    header, so any of them can be read alone.  Empty cells are quoted, so that a
    row of one empty cell is not a blank line, which readers skip.
    """
    (
        as_text(capped(df, row_limit, order=order))
        .write.mode(mode)
        .options(
            header=include_headers,
            maxRecordsPerFile=batch_rows or 0,
            emptyValue='""',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            **_QUOTED,
        )
        .csv(path)
    )


def read_export(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """What ``write_grid`` wrote with headers, as text columns; every file's first record is its header."""
    rows = _Files(spark, path, ",").rows(True).where(F.col("number") > 0)
    table = _cells(rows, len(columns), ",")
    texts = [F.coalesce(F.col("row")[f"c{i}"], F.lit("")) for i in range(len(columns))]
    return table.select(*[t.alias(c) for t, c in zip(texts, columns, strict=True)])
