"""Benchmark decontamination with suffix arrays of the training text.

The documents of a task are cut into shards, runs of whole documents of a few
megabytes. A shard's words become numbers of the benchmark's vocabulary, 0 for all
others, and its suffix array lists the places where a benchmark suffix could start
(a run of known words as long as the shortest window), sorted by their words to the
depth of a window. Every benchmark suffix is binary-searched in the suffix array;
hits that follow each other along one item are one verbatim match, so the longest
match is found with its places. Documents with a hit can then be removed.

The benchmark is the query set: it is dealt into blocks of about ``BLOCK_CHARS``
characters, each of which is sent to all tasks; the size is summed up before. One
block needs no shuffle; several blocks' matches are put together by document.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A
window is ``window`` words of an item, or a shorter item as a whole.

Cases: NULL and empty texts have no words; items without words are never found. Rows
of the benchmark that repeat an item_id are one item with several texts; a NULL
item_id is counted as no item, but its words are hit. Each document row gets its own
result. An empty benchmark finds nothing. Other columns go through; columns with the
results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.functions.names import free_names
from answergrid.llm.batches import slices, stored, texts_of, words

WINDOW = 10
BLOCK_CHARS = 16_000_000
RESULTS = ["n_words", "n_hit", "n_items", "items", "longest", "matches", "contaminated"]
_MATCH = "struct<item_id:bigint,doc_word:bigint,item_word:bigint,n_words:bigint>"


class Block:
    """Some benchmark items, numbered by their own vocabulary."""

    def __init__(self, item_ids: list, texts: list, window: int):
        hashes, first = words(pa.array(texts, pa.string()))
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.item_ids, self.window = item_ids, window
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.packed = 63 // self.bits
        lengths = np.diff(first)
        self.shortest = int(min(lengths[lengths > 0].min(), window)) if lengths.any() else 0
        #: One row per item suffix that holds a window: its item, its place, its words.
        suffixes = [
            (i, at, tuple((ids[first[i] + at : first[i] + at + min(window, n)] + 1).tolist()))
            for i, n in enumerate(lengths.tolist())
            for at in range(max(n - window + 1, min(n, 1)))
        ]
        #: By window: the suffixes that start with it.
        self.found: dict[tuple, list[tuple[int, int]]] = {}
        for item, at, key in suffixes:
            self.found.setdefault(key, []).append((item, at))
        self.windows = list(self.found)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)

    def keys(self, numbers: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The window's words from each place on, packed into a few sort keys."""
        out = []
        for start in range(0, self.window, self.packed):
            key = np.zeros(len(at), np.int64)
            for i in range(start, min(start + self.packed, self.window)):
                key = (key << self.bits) | numbers[at + i]
            out.append(key)
        return out

    def hits(self, numbers: np.ndarray) -> list[tuple[np.ndarray, int, list[tuple[int, int]]]]:
        """Per window that occurs: its places, its length and the suffixes it starts."""
        if not self.windows:
            return []
        padded = np.concatenate((numbers, np.zeros(self.window, np.int64)))
        stops = np.concatenate((np.flatnonzero(padded == 0), [len(padded)]))
        run = stops[np.searchsorted(stops, np.arange(len(numbers)))] - np.arange(len(numbers))
        at = np.flatnonzero(run >= self.shortest)
        keys = self.keys(padded, at)
        array = np.lexsort(keys[::-1])
        suffix, sorted_keys = at[array], [k[array] for k in keys]
        low, high = self._bounds(sorted_keys, False), self._bounds(sorted_keys, True)
        return [
            (suffix[a:b], len(w), self.found[w])
            for w, a, b in zip(self.windows, low.tolist(), high.tolist(), strict=True)
            if b > a
        ]

    def _bounds(self, sorted_keys: list[np.ndarray], upper: bool) -> np.ndarray:
        """Binary search of all windows at once; a short one is bounded by 0s or by the largest words."""
        fill = (1 << self.bits) - 1 if upper else 0
        table = np.array([[*w, *[fill] * (self.window - len(w))] for w in self.windows], np.int64)
        asked = self.keys(np.concatenate((table, np.zeros((len(table), self.window), np.int64)), 1).ravel(), np.arange(len(table)) * 2 * self.window)
        low, high = np.zeros(len(table), np.int64), np.full(len(table), len(sorted_keys[0]), np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, max(len(sorted_keys[0]) - 1, 0))
            before, equal = np.zeros(len(table), bool), np.ones(len(table), bool)
            for key, own in zip(asked, sorted_keys, strict=True):
                before |= equal & (own[middle] < key)
                equal &= own[middle] == key
            if upper:
                before |= equal
            low = np.where(open_ & before, middle + 1, low)
            high = np.where(open_ & ~before, middle, high)
        return low


def _matches(block: Block, hashes: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Per document its longest verbatim matches: item's index, place in the document and the item, words."""
    docs = len(first) - 1
    # A 0 after each document keeps matches inside it.
    place = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(first))
    numbers = np.zeros(len(hashes) + docs, np.int64)
    if len(block.vocabulary):
        numbers[place] = block.numbered(hashes)
    starts = first[:-1] + np.arange(docs)
    spots, items, ats, sizes = [], [], [], []
    for where, size, suffixes in block.hits(numbers):
        for item, at in suffixes:
            spots.append(where)
            items.append(np.full(len(where), item))
            ats.append(np.full(len(where), at))
            sizes.append(np.full(len(where), size))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(docs)]
    if not spots:
        return out
    spot, item, at, size = (np.concatenate(x) for x in (spots, items, ats, sizes))
    order = np.lexsort((spot, spot - at, item))
    spot, item, at, size = spot[order], item[order], at[order], size[order]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (spot[1:] != spot[:-1] + 1) | (at[1:] != at[:-1] + 1)))
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(spot)])) - 1
    doc = np.searchsorted(starts, spot[begin], "right") - 1
    length = last - begin + size[begin]
    for d, i, s, a, n in zip(doc.tolist(), item[begin].tolist(), (spot[begin] - starts[doc]).tolist(), at[begin].tolist(), length.tolist(), strict=True):
        out[d].append((i, s, a, n))
    return out


def _search(shared, fields: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in slices(batches):
            hashes, first = words(texts_of(batch))
            found = [
                [{"item_id": block.item_ids[i], "doc_word": s, "item_word": a, "n_words": n} for i, s, a, n in sorted(m, key=lambda x: (x[1], x[0], x[2]))]
                for m in _matches(block, hashes, first)
            ]
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "doc_word", "item_word", "n_words")]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(first).astype(np.int64)), pa.array(found, kind)], fields
            )

    return search


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> list[Block]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text") + 100)).first()[0] or 0
    count = max(1, -(-size // block_chars))
    blocks = []
    for number in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        blocks.append(Block([r["item_id"] for r in rows], [r["text"] for r in rows], window))
    return blocks


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents with what they share with the benchmark.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``
    and ``items`` (sorted ids of the items with an occurring window), ``longest`` (words
    of the longest verbatim match), ``matches`` (item, places in document and item,
    words) and ``contaminated``.
    """
    spark = docs.sparkSession
    plain = docs.drop(*RESULTS)
    blocks = _blocks(benchmark, window, block_chars)
    added = f"n_words long, matches array<{_MATCH}>"
    if len(blocks) == 1:
        schema = _with(plain, added)
        found = plain.mapInArrow(_search(spark.sparkContext.broadcast(blocks[0]), schema.names), schema)
    else:
        (number,) = free_names([*plain.columns, *RESULTS], "row")
        rows = stored(plain.withColumn(number, F.expr("uuid()")), "contamination-rows")
        schema = _with(rows.select(number, "text"), added)
        parts = [
            rows.select(number, "text").mapInArrow(_search(spark.sparkContext.broadcast(b), schema.names), schema).drop("text")
            for b in blocks
        ]
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        both = both.groupBy(number).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
        both = both.withColumn("matches", F.array_sort("matches"))
        found = rows.join(both, number).drop(number)
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b")))),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda t, m: F.struct(
            F.greatest(t["end"], m["b"]).alias("end"),
            (t["n"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(t["end"], m["a"]))).alias("n"),
        ),
        lambda t: t["n"],
    )
    items = F.array_sort(F.array_compact(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))))
    return found.select(
        *plain.columns,
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest"),
        "matches",
        (F.size("matches") > 0).alias("contaminated"),
    )


def _with(df: DataFrame, added: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that share no window with the benchmark."""
    return find_benchmark(docs, benchmark, window).where("not contaminated").select(*docs.columns)
