"""Quality rules: repetition and size rules, then n-gram perplexity bands per language.

A character, in lower case, is one of 4,096 symbols, and every language gets a modified
Kneser-Ney model of symbol 5-grams, whose number grows with the text.

1. Tasks count the 5-grams of their texts; Spark adds the counts up. How many symbols
   come before a gram is its count in the next lower order.
2. Spark computes the probabilities order by order, from single symbols up: a window over
   each context (of at most 4,096 grams) and a join with the order below. A text is part
   of the corpus that judges it, so each gram's probability leaves one occurrence of
   itself out: text that is like no other gets the low probability it would have had.
3. The grams of each language and their log-probabilities are sorted arrays in the shared
   folder. Every gram of a text has been counted, so scoring needs no lower orders.
   Tasks search the arrays, ``ROUND_GRAMS`` grams (12 bytes each) at a time, which bounds
   every broadcast; a larger model takes several passes, whose sums are added per row.

A text's score is its log-perplexity, the mean negative log-probability of its symbols.
Per language a band rejects the texts outside it. Its middle is the median of all texts
that pass the rules. How far they lie from it, divided by ``sqrt(1 + SHORT / characters)``
since the mean of a shorter text varies more, has a median below the middle and one above;
the edges are ``BELOW`` and ``ABOVE`` of their own side's deviations (of at least
``LEAST_DEVIATION``) away.
Texts of one language, length and score count once, so that copies do not narrow a band.

Cases: NULL text has no words and fails the rules. A NULL lang and an empty one are one
language. A language whose texts all fail the rules has no band and rejects nothing more.
Every row gets a result, repeated rows too; an empty table gives an empty one. Other
columns go through; columns with the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.functions.names import free_names
from answergrid.llm.batches import SPACE, rolling, runs, slices, span_hashes, stored, text_bytes, texts_of, windows

ORDER = 5
BITS = 12
#: A task counts this many grams before it gives them out, and stores them in arrays of PIECE_GRAMS.
HELD_GRAMS = 1 << 22
PIECE_GRAMS = 1 << 18
#: Grams that tasks hold at a time while they score.
ROUND_GRAMS = 1 << 23
BELOW = 4.0
ABOVE = 3.5
SHORT = 3000
LEAST_DEVIATION = 0.01
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = b"#*$%&|<>"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed", "kept"]
_COUNTS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("log_perplexity", T.DoubleType())]


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point: 0 for white space, 48 for digits, else the last 12 bits of its lower case."""
    table = np.arange(0x110000)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            table[i] = 0
        elif c.isdigit():
            table[i] = 48
        elif c.isupper():
            table[i] = ord(c.lower()[0])
    return table & ((1 << BITS) - 1)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each symbol, and its row; a text begins after white space."""
    texts = column.fill_null("").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = _symbols()[codes]
    row = np.repeat(np.arange(len(texts)), sizes)
    same = np.concatenate(([False], row[1:] == row[:-1])) if len(row) else np.zeros(0, bool)
    keep = (symbol != 0) | ~np.concatenate(([False], symbol[:-1] == 0))[: len(symbol)] | ~same
    symbol, row = symbol[keep], row[keep]
    key = symbol.copy()
    for back in range(1, ORDER):
        if len(symbol) > back:
            key[back:] |= np.where(row[back:] == row[:-back], symbol[:-back], 0) << (BITS * back)
    return key, row


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(["" if x is None else x for x in texts_of(batch, "lang").to_pylist()], dtype=object)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams and their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    fresh = 0

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches):
        key, row = grams(texts_of(batch))
        lang = _languages(batch)
        for name in dict.fromkeys(lang):
            mine, counts = np.unique(key[(lang == name)[row]], return_counts=True)
            if len(mine):
                held.setdefault(name, []).append((mine, counts.astype(np.int64)))
                fresh += len(mine)
        if fresh >= HELD_GRAMS:
            for name, parts in held.items():
                held[name] = [_added(parts)]
            if 2 * sum(len(parts[0][0]) for parts in held.values()) > HELD_GRAMS:
                yield from given()
            fresh = 0
    yield from given()


def _discounts(level: DataFrame) -> DataFrame:
    """Per language the three discounts of modified Kneser-Ney, from the counts of counts; one row a language."""
    times = level.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    plain = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.5))
    bounded = [F.least(F.greatest(d, F.lit(0.05)), F.lit(i + 0.95)) for i, d in enumerate(plain)]
    used = [F.when((n1 > 0) & (n2 > 0), d).otherwise(0.5).alias(f"d{i + 1}") for i, d in enumerate(bounded)]
    return times.select("lang", *used)


def _discount(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _mixed_up(level: DataFrame, below: DataFrame | None, order: int) -> DataFrame:
    """``prob`` of each gram, and ``left_out``: its probability without one occurrence of itself."""
    n = F.col("n")
    # Written, so that Spark knows how small it is and need not deal grams by language.
    level = level.join(stored(_discounts(level), "gram-discounts"), "lang")
    context = Window.partitionBy("lang", F.shiftright("gram", BITS))
    level = level.withColumn("total", F.sum("n").over(context)).withColumn("off", F.sum(_discount(n)).over(context))
    if below is None:
        level = level.withColumn("low", F.lit(2.0**-BITS)).withColumn("low_out", F.lit(2.0**-BITS))
    else:
        level = level.withColumn("suffix", _suffix(order - 1))
        level = level.join(below.select("lang", F.col("gram").alias("suffix"), F.col("prob").alias("low"), F.col("left_out").alias("low_out")), ["lang", "suffix"])
    total, off, low, low_out = (F.col(c) for c in ("total", "off", "low", "low_out"))
    less = n - 1 - _discount(n - 1) + (off - _discount(n) + _discount(n - 1)) * F.when(n == 1, low_out).otherwise(low)
    return level.select(
        "lang", "gram", ((n - _discount(n) + off * low) / total).alias("prob"), F.when(total > 1, less / (total - 1)).otherwise(low_out).alias("left_out")
    )


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (order * BITS)) - 1).cast("long"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang, gram, prob, left_out`` of counted 5-grams (``lang, gram, n``)."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.append(stored(levels[-1].groupBy("lang", _suffix(order).alias("gram")).agg(F.count("*").alias("n")), "gram-counts"))
    below = None
    for order, level in enumerate(reversed(levels), 1):
        below = _mixed_up(level, below, order)
    return below


def to_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted arrays of the grams of each language and their log-probabilities."""
    held: list[pa.RecordBatch] = []

    def given() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([("lang", "ascending"), ("gram", "ascending")])
        lang = np.array(table.column("lang").to_pylist(), dtype=object)
        gram, log_prob = table.column("gram").to_numpy(), table.column("log_prob").to_numpy()
        for name in dict.fromkeys(lang):
            mine = lang == name
            columns = [[name], [int(mine.sum())], [gram[mine].astype("<i8").tobytes()], [log_prob[mine].astype("<f4").tobytes()]]
            types = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "n", "grams", "log_probs"])
        held.clear()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PIECE_GRAMS:
            yield from given()
    if held:
        yield from given()


def train(docs: DataFrame) -> DataFrame:
    """The models of all languages of ``text, lang`` rows, as pieces of sorted arrays."""
    counts = docs.select("text", "lang").mapInArrow(count_grams, "lang string, gram long, n long")
    counts = stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    logs = kneser_ney(counts).select("lang", "gram", F.log("left_out").cast("float").alias("log_prob"))
    pieces = logs.mapInArrow(to_arrays, "lang string, n long, grams binary, log_probs binary")
    return stored(pieces.withColumn("piece", F.expr("uuid()")), "language-models")


def repeats(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Per row: words, their code points, symbols, repeated lines, words in repeated 8-word windows."""
    data, offsets = text_bytes(column)
    n = len(column)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    space = SPACE[data]
    chars = np.bincount(row_of[~space & ((data & 0xC0) != 0x80)], minlength=n)
    symbols = np.bincount(row_of[np.isin(data, np.frombuffer(SYMBOLS, np.uint8))], minlength=n)
    starts, ends = runs(~space, offsets)
    first = np.searchsorted(starts, offsets)
    word = span_hashes(data, starts, ends)
    line_starts, line_ends = runs(data != 10, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_row = row_of[line_starts] if len(line_starts) else np.zeros(0, np.int64)
    line = span_hashes(data, line_starts, line_ends)
    dup_lines = np.bincount(line_row[_again(line, line_row, True)], minlength=n)
    at, row = windows(first, 8)
    twice = _again(rolling(word, 8)[at], row, False)
    cover = np.zeros(len(word) + 9, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    covered = np.cumsum(cover)[: len(word)] > 0
    word_row = np.repeat(np.arange(n), np.diff(first))
    return np.diff(first), chars, symbols, dup_lines, np.bincount(word_row[covered], minlength=n)


def _again(hashes: np.ndarray, row: np.ndarray, later_only: bool) -> np.ndarray:
    """Marks what occurs more than once in its row; only from the second on if asked."""
    order = np.lexsort((hashes, row))
    same = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    if not later_only:
        out[order[:-1][same]] = True
    return out


def _rounds(models: DataFrame, most: int) -> list[list[str]]:
    """The pieces of each round, in the order of their languages; there are 2^18 grams to a piece."""
    rounds, room = [[]], most
    for r in models.select("piece", "n").orderBy("lang", "piece").toLocalIterator():
        if rounds[-1] and r["n"] > room:
            rounds.append([])
            room = most
        rounds[-1].append(r["piece"])
        room -= r["n"]
    return rounds


def _arrays(models: DataFrame, pieces: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sorted arrays of one round, by language."""
    parts: dict[str, list] = {}
    for r in models.where(F.col("piece").isin(pieces)).collect() if pieces else []:
        parts.setdefault(r["lang"], []).append((np.frombuffer(r["grams"], "<i8"), np.frombuffer(r["log_probs"], "<f4")))
    out = {}
    for lang, found in parts.items():
        gram, log_prob = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(gram)
        out[lang] = gram[order], log_prob[order]
    return out


def score(docs: DataFrame, round_grams: int = ROUND_GRAMS) -> DataFrame:
    """The documents with the counts of the rules and ``log_perplexity``."""
    spark = docs.sparkSession
    plain = docs.drop(*RESULTS)
    number, more = free_names([*plain.columns, *RESULTS], "row", "more")
    models = train(plain)
    rounds = _rounds(models, round_grams)
    if len(rounds) > 1:
        # Rows get a number in a written table, so that the sums of all rounds find them again.
        plain = stored(plain.withColumn(number, F.expr("uuid()")), "quality-rows")
    counted = T.StructType([*plain.schema.fields, *[T.StructField(n, t) for n, t in _COUNTS]])
    last = spark.sparkContext.broadcast(_arrays(models, rounds[-1]))
    scored = plain.mapInArrow(_scorer(last, counted.names), counted)
    sums = []
    for pieces in rounds[:-1]:
        arrays = _arrays(models, pieces)
        asked = plain.where(F.coalesce("lang", F.lit("")).isin(list(arrays))).select(number, "text", "lang")
        sums.append(stored(asked.mapInArrow(_summer(spark.sparkContext.broadcast(arrays), number, more), f"{number} string, {more} double"), "quality-sums"))
    if not sums:
        return scored
    added = reduce(DataFrame.unionByName, sums).groupBy(number).agg(F.sum(more).alias(more))
    scored = scored.join(added, number, "left")
    whole = F.col("log_perplexity") + F.coalesce(more, F.lit(0.0))
    return scored.withColumn("log_perplexity", whole).drop(number, more)


def surprise(batch: pa.RecordBatch, arrays: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per row the mean negative log-probability of its symbols; a gram that is not in the arrays adds nothing."""
    key, row = grams(texts_of(batch))
    lang = _languages(batch)
    total = np.zeros(batch.num_rows)
    for name in dict.fromkeys(lang):
        if name in arrays:
            known, log_prob = arrays[name]
            mine = np.flatnonzero((lang == name)[row])
            mine = mine[np.argsort(key[mine])]
            asked = key[mine]
            first = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1]))) if len(asked) else mine
            place = np.minimum(np.searchsorted(known, asked[first]), len(known) - 1)
            value = np.where(known[place] == asked[first], log_prob[place], 0.0)
            total += np.bincount(row[mine], np.repeat(value, np.diff(np.append(first, len(asked)))), batch.num_rows)
    return -total / np.maximum(np.bincount(row, minlength=batch.num_rows), 1)


def _scorer(shared, names: list[str]):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [pa.array(np.asarray(x, np.int64)) for x in repeats(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(surprise(batch, shared.value) + 0.0)], names)

    return scored


def _summer(shared, number: str, more: str):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([texts_of(batch, number), pa.array(surprise(batch, shared.value))], [number, more])

    return summed


def judge_quality(docs: DataFrame) -> DataFrame:
    """The documents, without their text, with the counts, ``log_perplexity``, ``base_failed`` and ``kept``."""
    scored = score(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = stored(scored.drop("text").withColumn("base_failed", failed), "quality-scores")
    bands = stored(_bands(scored.where("not base_failed").select("lang", "word_chars", "log_perplexity")), "perplexity-bands")
    own, middle, below, above = names = free_names([*scored.columns, "kept"], "l", "middle", "below", "above")
    off = F.col("log_perplexity") - F.col(middle)
    inside = F.coalesce((off / _wider()).between(-F.col(below), F.col(above)), F.lit(True))
    judged = scored.join(bands.select("l", "middle", "below", "above").toDF(*names), F.coalesce("lang", F.lit("")) == F.col(own), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & inside).drop(*names)


def _wider() -> Column:
    return F.sqrt(1 + SHORT / F.greatest("word_chars", F.lit(1)))


def _bands(passed: DataFrame) -> DataFrame:
    """``l, middle, below, above``: the middle of each language, and how far its band reaches to each side."""
    # In small steps, so that exact percentiles need a bounded number of values.
    step = F.round(F.col("log_perplexity") * 1000).cast("long")
    passed = stored(passed.select(F.coalesce("lang", F.lit("")).alias("l"), "word_chars", step.alias("x")).distinct(), "perplexities")
    middle = stored(passed.groupBy("l").agg(F.percentile("x", F.lit(0.5)).alias("middle")), "perplexity-medians")
    off = F.round(10 * (F.col("x") - F.col("middle")) / _wider()).cast("long")
    reaches = [
        (F.greatest(F.percentile(F.when(side * F.col("off") >= 0, F.abs("off")), F.lit(0.5)) * 1.4826 / 10_000, F.lit(LEAST_DEVIATION)) * width).alias(name)
        for name, side, width in (("below", -1, BELOW), ("above", 1, ABOVE))
    ]
    return passed.join(middle, "l").withColumn("off", off).groupBy("l", (F.col("middle") / 1000).alias("middle")).agg(*reaches)
