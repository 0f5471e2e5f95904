"""Records of grid files, which may go over several lines, read by as many tasks as there are splits.

A quoted cell may hold line breaks, so where a record begins depends on whether its line
lies within quotes, and that on all lines before.  A task that reads a split from the middle
of a file cannot know; but it can say how the split ends for either beginning:

1. Every split is read once.  What leaves its task is one row: whether it ends within
   quotes, and how many records begin in it, for both beginnings.
2. The true beginnings are a running composition of these over each file's splits, and the
   numbers of their first records a running sum.  A split either ends one way whatever its
   beginning, or keeps its beginning, or turns it round; so the state is the last fixed one,
   turned round as often as splits since then do.
3. Every split is read again and gives out its records, with numbers that depend on the
   file alone.  Records that go over a split's end are put together from their parts, of
   which a split has two at most; all others stay in the task that reads them.

Nothing is written but these parts.  What tasks are sent is some 20 bytes per split.
Splits are those of the first reading, whatever the session's options become.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answergrid.sources.shared import new_path

# Tasks get this module's code along, so that it need not be installed where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPLIT_OPTIONS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, value``: the lines of text files, in splits that stay as they are.

    Spark splits files anew for every query, by the options of the session that reads them;
    so a session of its own reads these.
    """
    own = spark.newSession()
    for option in _SPLIT_OPTIONS:
        own.conf.set(option, spark.conf.get(option))
    least = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism
    own.conf.set("spark.sql.files.minPartitionNum", str(least))
    view = f"lines_{uuid.uuid4().hex}"
    lines = own.read.option("lineSep", "\n").text(path)
    columns = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"]
    lines.select(*columns).createGlobalTempView(view)
    try:
        return spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)


class Quotes:
    """Whether a line ends within quotes, by whether it begins there.

    A quote opens a cell only as its first character; within quotes, two of them are one
    character.  After the closing one, a cell goes on to the next separator.
    """

    def __init__(self, sep: str):
        mark = re.escape(sep.encode())
        other = rb"[^%s]*+" % mark if len(sep.encode()) == 1 else rb"(?:(?!%s).)*+" % mark
        closing = rb'[^"]*+(?:""[^"]*+)*+"' + other
        cell = rb'(?:"%s|(?!")%s)' % (closing, other)
        self.sep = sep.encode()
        self.whole = re.compile(cell + rb"(?:%s%s)*+" % (mark, cell), re.DOTALL)
        self.closed = re.compile(closing, re.DOTALL)
        self.cell = re.compile(cell + rb"(%s|\Z)" % mark, re.DOTALL)

    def cells(self, record: bytes) -> int:
        """The cells of a record; what lies within quotes that never close is one."""
        at, count = 0, 1
        while (found := self.cell.match(record, at)) and found[1]:
            at, count = found.end(), count + 1
        return count

    def after(self, line: bytes, within: bool) -> bool:
        start = 0
        if within:
            found = self.closed.match(line)
            if not found:
                return True
            start = found.end()
            if start == len(line):
                return False
            start += len(self.sep)
        return self.whole.fullmatch(line, start) is None


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each batch, apart by split, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(0), batch.column(1)
        known = file.dictionary_encode()
        code, at = known.indices.to_numpy(), block.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(at) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield (known.dictionary[int(code[a])].as_py(), int(at[a])), batch.column(2).slice(a, b - a)


def _quoted(lines: pa.Array) -> np.ndarray:
    """The numbers of the lines that hold a quote: no other line changes anything."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


def _widest(quotes: Quotes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            values = batch.column(0)
            quoted = _quoted(values)
            plain = np.ones(len(values), bool)
            plain[quoted] = False
            separators = pc.count_substring(values, quotes.sep.decode()).to_numpy(zero_copy_only=False)
            most = max([most, 1 + int(separators[plain].max(initial=0)), *(quotes.cells(values[i].as_buffer().to_pybytes()) for i in quoted.tolist())])
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], ["width"])

    return work


def width_of(rows: DataFrame, sep: str) -> int:
    """The most cells that a record in ``value`` has."""
    return rows.select("value").mapInArrow(_widest(Quotes(sep)), "width long").agg(F.max("width")).first()[0] or 1


def _both_ways(quotes: Quotes):
    """One row per split: how it ends, and how many records begin in it, by how it begins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, within, begun = None, [False, True], [0, 0]

        def given() -> pa.RecordBatch:
            columns = [[split[0]], [split[1]], [within[0]], [within[1]], [begun[0]], [begun[1]]]
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["file", "block", "from_out", "from_in", "begun_out", "begun_in"],
            )

        for own, lines in _splits(batches):
            if own != split:
                if split:
                    yield given()
                split, within, begun = own, [False, True], [0, 0]
            at = 0
            for i in _quoted(lines).tolist():
                line = lines[i].as_buffer().to_pybytes()
                for way in (0, 1):
                    begun[way] += 0 if within[way] else i - at + 1
                ends = {state: quotes.after(line, state) for state in set(within)}
                within = [ends[state] for state in within]
                at = i + 1
            for way in (0, 1):
                begun[way] += 0 if within[way] else len(lines) - at
        if split:
            yield given()

    return work


class _Known:
    """The true beginning and the number of the first record of each split."""

    def __init__(self, pieces: pa.Table):
        files, blocks = pieces.column("file").to_pylist(), pieces.column("block").to_pylist()
        self.places = {name: i for i, name in enumerate(sorted(set(files)))}
        keys = sorted(range(len(files)), key=lambda i: (self.places[files[i]], blocks[i]))
        self.file = np.array([self.places[files[i]] for i in keys], np.int32)
        self.block = np.array([blocks[i] for i in keys], np.int64)
        self.within = pieces.column("within").to_numpy(zero_copy_only=False)[keys].astype(bool)
        self.first = pieces.column("first").to_numpy()[keys]

    def of(self, split: tuple[str, int]) -> tuple[bool, int]:
        name = self.places.get(split[0], -1)
        low, high = np.searchsorted(self.file, name), np.searchsorted(self.file, name, "right")
        at = low + np.searchsorted(self.block[low:high], split[1])
        if at == high or self.block[at] != split[1]:
            raise ValueError(f"{split[0]} has changed or is split anew while it is read")
        return bool(self.within[at]), int(self.first[at])


def _cut(quotes: Quotes, known, parts: bool):
    """The records that lie in one split; or the parts of those that do not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, within, number, held, first = None, False, 0, [], False

        def rows(numbers: list[int] | np.ndarray, values: pa.Array) -> pa.RecordBatch:
            columns = [pa.array([split[0]] * len(values), pa.string()), pa.array(numbers, pa.int64())]
            columns += [pa.array([split[1]] * len(values), pa.int64()), values]
            return pa.RecordBatch.from_arrays(columns, ["file", "number", "block", "value"])

        def text(values: list[bytes]) -> pa.Array:
            kept = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
            return pc.cast(pa.array(values, pa.binary()), options=kept)

        def left() -> Iterator[pa.RecordBatch]:
            """What is still open: the last record of its split, or a split within one record."""
            if held and parts == (within or first):
                yield rows([number - 1], text([b"\n".join(held)]))

        for own, lines in _splits(batches):
            if own != split:
                yield from left()
                split, held = own, []
                within, number = known.value.of(own)
                first = within  # the record that is open began in a split before
            quoted = _quoted(lines)
            if not len(quoted) and not within:
                yield from left()
                if not parts and len(lines) > 1:
                    yield rows(np.arange(number, number + len(lines) - 1), lines.slice(0, len(lines) - 1))
                number += len(lines)
                held, first = [lines[len(lines) - 1].as_buffer().to_pybytes()], False
                continue
            values, numbers = [], []
            marks = set(quoted.tolist())
            for i, line in enumerate(lines.cast(pa.binary()).to_pylist()):
                if not within:
                    if held and parts == first:
                        values.append(b"\n".join(held))
                        numbers.append(number - 1)
                    held, first = [], False
                    number += 1
                held.append(line)
                if i in marks:
                    within = quotes.after(line, within)
            if values:
                yield rows(numbers, text(values))
        if split:
            yield from left()

    return work


@dataclass(frozen=True)
class Records:
    """The records of ``lines``: ``file, block, value`` in the order they are read.

    Lines end in a line feed; a carriage return before it is part of the line, but not of
    a record that ends there.
    """

    lines: DataFrame
    sep: str = ","

    @cached_property
    def pieces(self) -> DataFrame:
        """``file, block, within, ends, first, n``: per split its two ends and its records; a small written table."""
        quotes = Quotes(self.sep)
        schema = "file string, block long, from_out boolean, from_in boolean, begun_out long, begun_in long"
        both = self.lines.mapInArrow(_both_ways(quotes), schema)
        order = Window.partitionBy("file").orderBy("block")
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
        fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("state"), "turned"))
        state = F.coalesce(F.col("fixed.state"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("fixed.turned"), F.lit(0))
        known = (
            both.withColumn("turned", F.sum(turns).over(so_far))
            .withColumn("fixed", F.last(fixed, ignorenulls=True).over(so_far))
            .withColumn("ends", F.pmod(state, F.lit(2)) == 1)
            .withColumn("within", F.coalesce(F.lag("ends").over(order), F.lit(False)))
            .withColumn("n", F.when(F.col("within"), F.col("begun_in")).otherwise(F.col("begun_out")))
            .select("file", "block", "within", "ends", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")
        )
        return self._written(known, "splits")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def counts(self) -> dict[str, int]:
        """The records of each file."""
        return {r["file"]: r["n"] for r in self.pieces.groupBy("file").agg(F.sum("n").alias("n")).collect()}

    @cached_property
    def rows(self) -> DataFrame:
        """``file, number, value``: every record, numbered from 0 in its file."""
        known = self.lines.sparkSession.sparkContext.broadcast(_Known(self.pieces.select("file", "block", "within", "first").toArrow()))
        quotes, schema = Quotes(self.sep), "file string, number long, block long, value string"
        whole = self.lines.mapInArrow(_cut(quotes, known, False), schema).select("file", "number", "value")
        if not self.pieces.where("within or ends").isEmpty():
            parts = self._written(self.lines.mapInArrow(_cut(quotes, known, True), schema), "record-parts")
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "\n")
            whole = whole.unionByName(parts.groupBy("file", "number").agg(joined.alias("value")))
        return whole.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
