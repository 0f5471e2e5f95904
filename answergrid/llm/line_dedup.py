"""Line dedup: lines that many documents share are dropped everywhere.

1. Every task counts, for each distinct line key of its documents, the documents
   that hold it; Spark adds the counts up by a 128-bit hash of the key.
2. The keys that reach the bar are dealt into shards of at most about
   ``SHARD_KEYS``. Each shard gets a minimal perfect hash (levels of bit arrays;
   a key's slot is the rank of its bit), which indexes an array of 64-bit
   fingerprints and an array of counts. Shards are written to the shared folder.
3. Documents probe the arrays: the first half of the hash finds shard and slot, the
   second half must equal the fingerprint. Lines are not joined or shuffled.

The shards are sent to the tasks in rounds of at most ``round_bytes``; a shard is smaller.
One round drops the lines at once. Several rounds each give out, per document, the numbers
of the lines that their shards know, and what all rounds found is dropped in the end: the
texts move once more, with the line numbers, and lines never do.

Cases: NULL or empty text is one empty line, whose key is empty and never drops.
Every row of the table is a document, also with a repeated or NULL doc_id. An
empty table gives an empty table. Other columns go through, whatever their names; columns
named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.functions.names import free_names
from answergrid.llm.batches import mixed, slices, stored, texts_of

STRIPPED = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 16
#: Bits per key of each level of a perfect hash.
ROOM = 2
ROUND_BYTES = 64 << 20
_ONES = np.array([i.bit_count() for i in range(256)], np.uint8)


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys; a key is the hash of a non-empty line, else empty."""
    lines = text.split(b"\n")
    return lines, [
        xxhash.xxh3_128_digest(key) if (key := line.strip(STRIPPED).lower()) else b"" for line in lines
    ]


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _utf8(batch: pa.RecordBatch) -> list[bytes]:
    return [v or b"" for v in texts_of(batch).cast(pa.binary()).to_pylist()]


def count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen: Counter[bytes] = Counter()
        for text in _utf8(batch):
            seen.update(set(line_keys(text)[1]))
        del seen[b""]
        halves = _halves(list(seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(list(seen.values()), pa.int64())],
            ["key", "print", "n"],
        )


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level: a key sets its bit in the first level where it is alone."""
    levels, rest = [], keys.view(np.uint64)
    while len(rest):
        place = mixed(rest, len(levels)) % np.uint64(ROOM * len(rest))
        alone = np.bincount(place.astype(np.int64), minlength=ROOM * len(rest)) == 1
        levels.append(alone)
        rest = rest[~alone[place.astype(np.int64)]]
    return levels


class Level:
    """One bit array of a perfect hash, packed, with the number of ones before each byte."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size
        ones = _ONES[packed]
        self.before = np.cumsum(ones, dtype=np.uint32) - ones
        self.count = int(ones.sum(dtype=np.int64))

    def look(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the bit at each place is set, and how many are before it."""
        byte, bit = self.packed[place >> 3], 7 - (place & 7)
        return (byte >> bit) & 1 == 1, self.before[place >> 3] + _ONES[byte >> (bit + 1)]


def packed_levels(levels: list[np.ndarray]) -> list[Level]:
    return [Level(np.packbits(bits), len(bits)) for bits in levels]


def slots(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that no level knows gets -1, a foreign key any slot."""
    found, base, rest = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
    for number, level in enumerate(levels):
        place = (mixed(keys[rest].view(np.uint64), number) % np.uint64(level.size)).astype(np.int64)
        here, rank = level.look(place)
        found[rest[here]] = base + rank[here]
        base += level.count
        rest = rest[~here]
    return found


SHARD_SCHEMA = "shard long, levels array<binary>, sizes array<int>, prints binary, counts binary"


def build_shard(key: tuple, table: pa.Table) -> pa.Table:
    keys, prints, n = (table.column(c).to_numpy() for c in ("key", "print", "n"))
    order = np.lexsort((prints, keys))
    keys, prints, n = keys[order], prints[order], n[order]
    #: Two lines may share the first half: the hash is built over the distinct halves, the others follow in runs.
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    extra = np.setdiff1d(np.arange(len(keys)), first)
    levels = perfect_hash(keys[first])
    place = slots(packed_levels(levels), keys[first])
    kept_prints, kept_n = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    kept_prints[place], kept_n[place] = prints[first], n[first]
    kept_prints = np.concatenate((kept_prints, prints[extra]))
    kept_n = np.concatenate((kept_n, n[extra]))
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "levels": pa.array([[np.packbits(b).tobytes() for b in levels]], pa.list_(pa.binary())),
            "sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int32())),
            "prints": pa.array([kept_prints.tobytes()], pa.binary()),
            "counts": pa.array([kept_n.tobytes()], pa.binary()),
        }
    )


class LineIndex:
    """Some of the shards, ready to be probed."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.arrays = {
            r["shard"]: (
                [Level(np.frombuffer(b, np.uint8), n) for b, n in zip(r["levels"], r["sizes"], strict=True)],
                np.frombuffer(r["prints"], np.int64),
                np.frombuffer(r["counts"], np.int64),
            )
            for r in rows
        }

    def counts(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """In how many documents each line is; 0 if it is not indexed here."""
        out = np.zeros(len(keys), np.int64)
        shard = np.mod(keys, self.shards)
        for number in np.unique(shard):
            if int(number) not in self.arrays:
                continue
            levels, known, n = self.arrays[int(number)]
            asked = np.flatnonzero(shard == number)
            slot = slots(levels, keys[asked])
            hit = (slot >= 0) & (known[slot] == prints[asked])
            out[asked[hit]] = n[slot[hit]]
            for i in range(sum(level.count for level in levels), len(known)):
                out[asked[known[i] == prints[asked]]] = n[i]
        return out


def line_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """``key, print, n``: the hashes of the lines that at least min_docs documents hold."""
    parts = docs.select("text").mapInArrow(count_lines, "key long, print long, n long")
    return parts.groupBy("key", "print").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def _common(texts: list[bytes], index: LineIndex, min_docs: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The lines of each text, and which of them the index knows to be common."""
    split = [line_keys(text) for text in texts]
    flat = [key for _, keys in split for key in keys]
    real = [i for i, key in enumerate(flat) if key]
    gone = np.zeros(len(flat), bool)
    if real:
        halves = _halves([flat[i] for i in real])
        gone[real] = index.counts(halves[:, 0], halves[:, 1]) >= min_docs
    cuts = np.cumsum([len(lines) for lines, _ in split])[:-1]
    return [lines for lines, _ in split], np.split(gone, cuts)


def _dropped(batch: pa.RecordBatch, lines: list[list[bytes]], gone: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    kept = [b"\n".join(x for x, g in zip(own, mine.tolist(), strict=True) if not g) for own, mine in zip(lines, gone, strict=True)]
    columns["text"] = pa.array(kept, pa.binary()).cast(pa.string())
    columns["n_lines"] = pa.array([len(own) for own in lines], pa.int64())
    columns["n_dropped"] = pa.array([int(mine.sum()) for mine in gone], pa.int64())
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def _rounds(index: DataFrame, most: int) -> list[list[int]]:
    """The numbers of the shards of each round; one row per shard of some 65,000 lines."""
    size = F.length("prints") + F.length("counts") + F.aggregate("sizes", F.lit(0), lambda a, n: a + n)
    rounds, room = [[]], most
    for r in index.select("shard", size.alias("size")).orderBy("shard").toLocalIterator():
        if rounds[-1] and r["size"] > room:
            rounds.append([])
            room = most
        rounds[-1].append(r["shard"])
        room -= r["size"]
    return rounds


def drop_common_lines(docs: DataFrame, min_docs: int = 10, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The documents without the lines that at least ``min_docs`` of them hold.

    ``text`` becomes what is left, joined by line breaks; ``n_lines`` (before) and
    ``n_dropped`` are added.
    """
    spark = docs.sparkSession
    plain = docs.drop("n_lines", "n_dropped")
    schema = T.StructType(
        [*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )
    common = stored(line_counts(plain, min_docs), "line-counts")
    shards = max(1, -(-common.count() // SHARD_KEYS))
    dealt = common.withColumn("shard", F.pmod("key", F.lit(shards)))
    index = stored(dealt.groupBy("shard").applyInArrow(build_shard, SHARD_SCHEMA), "line-index")
    rounds = _rounds(index, round_bytes)

    def sent(numbers: list[int]):
        rows = index.where(F.col("shard").isin(numbers)).collect() if numbers else []
        return spark.sparkContext.broadcast(LineIndex(rows, shards))

    if len(rounds) == 1:
        shared = sent(rounds[0])

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield _dropped(batch, *_common(_utf8(batch), shared.value, min_docs), schema.names)

        return plain.mapInArrow(drop, schema)

    number, gone = free_names([*plain.columns, "n_lines", "n_dropped"], "row", "gone")
    rows = stored(plain.withColumn(number, F.expr("uuid()")), "line-rows")
    found = []
    for numbers in rounds:
        shared = sent(numbers)

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                _, known = _common(_utf8(batch), shared.value, min_docs)
                hit = [i for i, mine in enumerate(known) if mine.any()]
                lists = pa.array([np.flatnonzero(known[i]) for i in hit], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([texts_of(batch, number).take(pa.array(hit, pa.int64())), lists], [number, gone])

        found.append(stored(rows.select(number, "text").mapInArrow(probe, f"{number} string, {gone} array<long>"), "lines-known"))
    every = reduce(DataFrame.unionByName, found).groupBy(number).agg(F.flatten(F.collect_list(gone)).alias(gone))

    def drop_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = [text.split(b"\n") for text in _utf8(batch)]
            marks = [np.zeros(len(own), bool) for own in lines]
            for mine, places in zip(marks, texts_of(batch, gone).to_pylist(), strict=True):
                mine[places or []] = True
            yield _dropped(batch, lines, marks, schema.names)

    return rows.join(every, number, "left").mapInArrow(drop_found, schema)
