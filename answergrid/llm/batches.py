"""Texts as byte arrays: what the operators that run NumPy inside tasks share.

A task gets Arrow batches from Spark and goes through them in slices of a few
megabytes, so a task's memory does not grow with its partition. A text longer
than a slice is a slice of its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from answergrid.sources.shared import new_path

SLICE_BYTES = 1 << 19


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """The rows, written to the shared folder (with the writer's options) and read again.

    This cuts the lineage, survives lost executors and gives Spark the true size.
    """
    spark: SparkSession = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin and end. NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    size = offsets[-1] - offsets[0]
    got = np.frombuffer(data, np.uint8, size, offsets[0]) if size else np.zeros(0, np.uint8)
    return got, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Digits, Latin letters and every byte of a character beyond ASCII.
WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well-mixed bits of 64 bits (the finisher of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mixed(np.arange(256, dtype=np.uint64), 7)


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base][:n]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of marked bytes; no run crosses a row's end."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: equal bytes, equal hash, wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_MULTIPLIER, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, in order, and the index of each row's first word (one more at the end).

    A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends = runs(WORD[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n hashes; windows may cross rows, callers mask them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[i : len(hashes) - n + 1 + i]
    return mixed(total)


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of n words lie inside one row: their index, and their row."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][rows] + inner, rows
