"""Phrase collocation mining: best-first growth of phrases, with a bound that ends the search.

A phrase of a words' counts ``a, l, r`` and its language's ``n`` words scores ``1000 * a * n
/ (l * r)``, rounded down, at the cut into two parts where this is least. No phrase occurs
more often than its rest after any first part, so ``1000 * n / f(first word)`` bounds the
score of every phrase that begins with a word: rare words first is best first.

1. Texts become arrays of 64-bit word hashes (seeded by the language, 0 between pieces),
   written once; words are counted from them, and told at the end.
2. Per language the words that can begin a phrase are dealt into batches, rarest first, of
   ``BATCH`` occurrences over all languages, and each batch twice as large as the last.
3. A batch grows word by word: every task looks up which of its places begin with a phrase
   that occurs often enough, and counts the phrases one word longer. Prefixes that do not
   reach the bar are cut off. What tasks look up is sent in parts of ``MOST_KEYS`` keys.
4. One more pass counts the rest of each candidate after each cut and what precedes it. A
   phrase lies in a longer one that is as frequent if and only if the same word always
   precedes it or always follows it, so no longer phrase outside the batch is needed.
5. A language is settled when its ``most``-th best surviving score is above the bound of all
   words of later batches (a bound equal to it could still tie); else its next batch grows.

Counts are exact, but for hashes: two words of a language share one with a probability of
2^-64. Products are decimals of 38 digits.

Cases: NULL text is empty; a NULL lang is ``und``. Every row counts, repeated rows too. A
text of any length is one array. Columns but ``text`` and ``lang`` are not looked at. An
empty table, or a language without a candidate, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergrid.llm.batches import LOWER, mixed, runs, slices, span_hashes, stored, text_bytes, texts_of

LEAST_COUNT = 100
LONGEST = 5
MOST = 2000
UNKNOWN = "und"
#: Occurrences of the words in the first batch, of all languages together.
BATCH = 1 << 25
#: Keys that tasks look up at a time: 16 MB.
MOST_KEYS = 1 << 21
#: Texts or token arrays that a task gets at once; a longer one comes alone.
BYTES_AT_ONCE = 1 << 21
#: Rows of them that a task reads at once.
READ_ROWS = 64
#: Rows that a task counts before it gives them out.
HELD_ROWS = 1 << 19
#: Rows that a task gives out at once.
GIVEN_ROWS = 1 << 16
_BYTE = np.arange(256)
#: Ends of pieces: .,;:!? and line breaks.
ENDS = np.isin(_BYTE, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
IN_WORD = ~ENDS & (_BYTE != 32) & (_BYTE != 9)


def hashed_words(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's language; the bytes of all texts in lower case; start, end, row, piece and hash of each word."""
    langs = [UNKNOWN if x is None else x for x in texts_of(batch, "lang").to_pylist()]
    data, offsets = text_bytes(texts_of(batch))
    data = LOWER[data]
    starts, ends = runs(IN_WORD[data], offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    seeds = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    seed = np.array([seeds[x] for x in langs], np.uint64)
    word = np.maximum(mixed(span_hashes(data, starts, ends) ^ seed[row]), np.uint64(1))
    piece = np.concatenate(([0], np.cumsum(ENDS[data])))[starts]
    return langs, data, starts, ends, row, piece, word


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the word hashes of a slice of texts, with a 0 wherever a piece or text ends."""
    for batch in slices(batches):
        langs, _, _, _, row, piece, word = hashed_words(batch)
        apart = np.concatenate(([False], (np.diff(piece) != 0) | (np.diff(row) != 0))) if len(word) else np.zeros(0, bool)
        for lang in dict.fromkeys(langs):
            kept = np.flatnonzero(np.array([x == lang for x in langs])[row])
            # Rows of other languages between two words are another text too.
            gaps = np.flatnonzero(apart[kept] | (np.diff(kept, prepend=kept[:1]) > 1))
            flat = np.append(np.insert(word[kept], gaps, 0), np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([flat.tobytes()], pa.binary())], ["lang", "tokens"])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Counts] = {}

    def given(lang: str) -> Iterator[pa.RecordBatch]:
        for part in held[lang].given(["word", "n"], 1):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * part.num_rows, pa.string()), *part.columns], ["lang", "word", "n"])

    for batch in batches:
        for i, lang in enumerate(texts_of(batch, "lang").to_pylist()):
            flat = _flat(batch.slice(i, 1))
            counts = held.setdefault(lang, _Counts(0))
            counts.add([flat[flat != 0]], np.ones(int((flat != 0).sum()), np.int64), [])
            if counts.size >= HELD_ROWS:
                yield from given(lang)
    for lang in held:
        yield from given(lang)


def _teller(asked: Broadcast):
    """The text of each word hash that is asked for."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in slices(batches):
            _, data, starts, ends, _, _, word = hashed_words(batch)
            word, at = np.unique(word, return_index=True)
            hit = np.flatnonzero(_known(asked.value, word))
            fresh = [i for i in hit.tolist() if int(word[i]) not in told]
            told.update(int(word[i]) for i in fresh)
            said = [data[starts[at[i]] : ends[at[i]]].tobytes() for i in fresh]
            yield pa.RecordBatch.from_arrays([pa.array(word[fresh].view(np.int64)), pa.array(said, pa.binary()).cast(pa.string())], ["word", "said"])

    return tell


def chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mixed(before * np.uint64(0xD1342543DE82EF95) + word)


def _known(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked), bool)
    return keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """The tokens of a batch, one row after the other; each row ends in 0."""
    column = texts_of(batch, "tokens").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint64, (at[-1] - at[0]) // 8, at[0])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4):
            yield batch.slice(at, 4)


def _passed(passed: DataFrame, name: str) -> DataFrame:
    """The result of a pass over the texts or token arrays, written.

    Spark reads, sends and packs into a page thousands of rows at a time, which suits short rows; these are long.
    """
    conf = passed.sparkSession.conf
    set_to = {"spark.sql.execution.arrow.maxBytesPerBatch": BYTES_AT_ONCE, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}
    before = {option: conf.get(option) for option in set_to}
    try:
        for option, value in set_to.items():
            conf.set(option, str(value))
        return stored(passed, name, **{"parquet.page.size.row.check.min": 1})
    finally:
        for option, value in before.items():
            conf.set(option, value)


class _Counts:
    """Rows with a key, summed up by key (and least and greatest of what else they have)."""

    def __init__(self, extremes: int):
        self.extremes, self.held, self.size = extremes, [], 0

    def add(self, keys: list[np.ndarray], times: np.ndarray, more: list[np.ndarray]) -> None:
        self.held.append(self._summed(keys, times, more))
        self.size += len(self.held[-1][0])

    def _summed(self, keys: list[np.ndarray], times: np.ndarray, more: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        first = np.flatnonzero(reduce(np.logical_or, [np.concatenate(([True], k[1:] != k[:-1])) for k in keys])) if len(order) else order
        if not len(order):
            return [*keys, times, *more]
        ends = [(np.minimum if i % 2 == 0 else np.maximum).reduceat(x[order], first) for i, x in enumerate(more)]
        return [*[k[first] for k in keys], np.add.reduceat(times[order], first), *ends]

    def given(self, names: list[str], keys: int) -> Iterator[pa.RecordBatch]:
        """All rows so far, once there are many or nothing more comes."""
        if self.held:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            columns = self._summed(columns[:keys], columns[keys], columns[keys + 1 :])
            batch = pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)
            for at in range(0, batch.num_rows, GIVEN_ROWS):
                yield batch.slice(at, GIVEN_ROWS)
        self.held, self.size = [], 0


def _grower(heads: Broadcast, prefixes: Broadcast, size: int):
    """Counts the phrases of ``size + 1`` words whose first words are one of the prefixes."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = _Counts(0), ["prefix", "word", "n"]
        for batch in _few(batches):
            flat = _flat(batch)
            at = np.flatnonzero(_known(heads.value, flat)) if len(flat) > size else np.zeros(0, np.int64)
            at = at[at < len(flat) - size]
            phrase = flat[at]
            inside = np.ones(len(at), bool)
            for i in range(1, size):
                inside &= flat[at + i] != 0
                phrase = chain(phrase, flat[at + i])
            hit = np.flatnonzero(inside & (flat[at + size] != 0))
            hit = hit[_known(prefixes.value, phrase[hit])]
            counts.add([phrase[hit], flat[at[hit] + size]], np.ones(len(hit), np.int64), [])
            if counts.size >= HELD_ROWS:
                yield from counts.given(names, 2)
        yield from counts.given(names, 2)

    return grow


def _rest_counter(asked: Broadcast):
    """Counts given phrases, and the least and greatest word before them (beyond all words where none is)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = _Counts(2), ["phrase", "n", "low", "high"]
        for batch in _few(batches):
            flat = _flat(batch)
            before = np.concatenate((np.zeros(1, np.uint64), flat[:-1])) if len(flat) else flat
            phrase, inside = flat, flat != 0
            for i in range(1, LONGEST - 1):
                if len(flat) <= i:
                    break
                phrase, inside = chain(phrase[: len(flat) - i], flat[i:]), inside[: len(flat) - i] & (flat[i:] != 0)
                hit = np.flatnonzero(inside)
                hit = hit[_known(asked.value, phrase[hit])]
                low = np.where(before[hit] == 0, np.uint64(0), before[hit])
                high = np.where(before[hit] == 0, ~np.uint64(0), before[hit])
                counts.add([phrase[hit]], np.ones(len(hit), np.int64), [low, high])
            if counts.size >= HELD_ROWS:
                yield from counts.given(names, 1)
        yield from counts.given(names, 1)

    return count


def _sent(keys: DataFrame, most: int) -> Iterator[list[Broadcast]]:
    """The distinct values of each column of ``keys``, sorted, in parts of about ``most`` rows by the first column."""
    keys = stored(keys.distinct(), "phrase-keys")
    count = keys.count()
    parts = max(1, -(-count // most))
    for part in range(parts if count else 0):
        own = keys.where(F.pmod(keys.columns[0], F.lit(parts)) == part).toArrow()
        yield [keys.sparkSession.sparkContext.broadcast(np.unique(own.column(c).to_numpy().view(np.uint64))) for c in keys.columns]


_CHAIN = "key long, parent long, lang string, words array<long>, counts array<long>"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent, word = (texts_of(batch, c).to_numpy().view(np.uint64) for c in ("parent", "word"))
        columns = [pa.array(chain(parent, word).view(np.int64)), *(texts_of(batch, c) for c in ("parent", "lang", "words", "counts"))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "parent", "lang", "words", "counts"])


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each candidate's rest after each cut, and of the candidate: ``rests`` from the first cut on."""
    for batch in batches:
        out = []
        for words in texts_of(batch, "words").to_pylist():
            row = np.array(words, np.int64).view(np.uint64)
            rests = []
            for cut in range(len(row)):
                phrase = row[cut : cut + 1]
                for i in range(cut + 1, len(row)):
                    phrase = chain(phrase, row[i : i + 1])
                rests.append(int(phrase.view(np.int64)[0]))
            out.append(rests[1:])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "rests"])


def grown(table: DataFrame, words: DataFrame, least: int, most_keys: int) -> DataFrame:
    """All phrases of two words or more that begin with one of the words and occur often enough.

    ``key, parent, lang, words, counts``: the hash, that of all words but the last, the words
    and how often each first part occurs.
    """
    start = words.select(F.col("word").alias("key"), F.lit(0).cast("long").alias("parent"), "lang", F.array("word").alias("words"), F.array("n").alias("counts"))
    level, found = stored(start, "phrases-1"), []
    for size in range(1, LONGEST):
        counted = []
        for prefixes, heads in _sent(level.select("key", F.element_at("words", 1).alias("head")), most_keys):
            longer = table.mapInArrow(_grower(heads, prefixes, size), "parent long, word long, n long")
            longer = longer.groupBy("parent", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            counted.append(_passed(longer, f"phrase-counts-{size + 1}"))
        if not counted:
            break
        before = level.drop("parent").withColumnRenamed("key", "parent")
        joined = reduce(DataFrame.unionByName, counted).join(before, "parent").select(
            "parent", "word", "lang", F.array_append("words", F.col("word")).alias("words"), F.array_append("counts", F.col("n")).alias("counts")
        )
        level = stored(joined.mapInArrow(_chained, _CHAIN), f"phrases-{size + 1}")
        found.append(level)
    return reduce(DataFrame.unionByName, found) if found else level.limit(0)


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def survivors(table: DataFrame, phrases: DataFrame, words: DataFrame, totals: DataFrame, most_keys: int) -> DataFrame:
    """``lang, words, a, l, r, n, score`` of the phrases that no longer one of equal count holds."""
    size, count = F.size("words"), F.element_at("counts", -1)
    phrases = stored(phrases.mapInArrow(_rests, _CHAIN + ", rests array<long>"), "phrase-rests")
    # A rest of one word is a word.
    longer_rests = F.slice("rests", F.lit(1), F.greatest(size - 2, F.lit(0)))
    asked = phrases.select(F.explode(longer_rests).alias("key")).unionByName(phrases.where(size < LONGEST).select("key"))
    counted = [_passed(table.mapInArrow(_rest_counter(*keys), "phrase long, n long, low long, high long"), "rest-counts") for keys in _sent(asked, most_keys)]
    same = (F.min("low") == F.max("low")) & (F.min("high") == F.max("high")) & (F.min("low") == F.min("high"))
    counts = reduce(DataFrame.unionByName, counted) if counted else phrases.sparkSession.createDataFrame([], "phrase long, n long, low long, high long")
    facts = stored(counts.groupBy("phrase").agg(F.sum("n").alias("f"), same.alias("follows_one")), "rest-facts")
    leads = phrases.groupBy(F.col("parent").alias("key")).agg(F.max(count).alias("longer"))
    alive = phrases.join(facts.select(F.col("phrase").alias("key"), "follows_one"), "key", "left").join(leads, "key", "left")
    alive = alive.where(~F.coalesce("follows_one", F.lit(False)) & (F.coalesce("longer", F.lit(0)) < count))
    firsts = F.slice("counts", F.lit(1), size - 1)
    cuts = alive.select(F.col("key"), "lang", "words", count.alias("a"), F.posexplode(F.arrays_zip(firsts.alias("l"), F.col("rests").alias("rest"))).alias("cut", "parts"))
    rest = facts.select("phrase", F.col("f").alias("r")).unionByName(words.select(F.col("word").alias("phrase"), F.col("n").alias("r")))
    parts = cuts.select("key", "lang", "words", "a", "cut", F.col("parts.l").alias("l"), F.col("parts.rest").alias("phrase")).join(rest, "phrase")
    parts = parts.join(totals, "lang").withColumn("top", F.lit(1000).cast("decimal(38,0)") * _wide("a") * _wide("n"))
    parts = parts.withColumn("under", _wide("l") * _wide("r")).withColumn("score", F.expr("top div under"))
    best = parts.groupBy("key").agg(F.min(F.struct("score", "cut", "lang", "words", "a", "l", "r", "n")).alias("best"))
    return best.select(*[f"best.{c}" for c in ("lang", "words", "a", "l", "r", "n", "score")])


def _batches(words: DataFrame, batch: int) -> DataFrame:
    """``lang, n, batch``: the batch of the words that occur n times; each holds twice as many occurrences as the one before."""
    sizes = stored(words.groupBy("lang", "n").agg((F.count("*") * F.col("n")).alias("size")), "word-sizes")
    share = batch / max(1, sizes.select("lang").distinct().count())
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(sizes.select("lang", "n", F.floor(F.log2(1 + before / share)).cast("int").alias("batch")), "word-batches")


def mine_phrases(docs: DataFrame, least: int = LEAST_COUNT, most: int = MOST, batch: int = BATCH, most_keys: int = MOST_KEYS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two to five words.

    ``a``, ``l`` and ``r`` are the counts of the phrase and of its parts at the cut that scores
    least, ``n`` the words of the language.
    """
    texts = docs.select("text", "lang")
    table = _passed(texts.mapInArrow(tokens, "lang string, tokens binary"), "word-hashes")
    counts = table.mapInArrow(count_words, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = _passed(counts, "word-counts")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "language-sizes")
    frequent = counts.where(F.col("n") >= least)
    dealt = _batches(frequent, batch)
    words = stored(frequent.join(dealt, ["lang", "n"]), "frequent-words")
    found, settled = [], None
    #: A few numbers: batches double, so there are about as many as the words have digits.
    for number in sorted(r["batch"] for r in dealt.select("batch").distinct().collect()):
        own = words.where(F.col("batch") == number)
        if settled is not None:
            own = own.join(settled, "lang", "left_anti")
        if own.isEmpty():
            continue
        phrases = grown(table, own, least, most_keys)
        found.append(stored(survivors(table, phrases, words, totals, most_keys), "phrases-found"))
        all_found = reduce(DataFrame.unionByName, found)
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        last = all_found.select("lang", "score").withColumn("place", place).where(F.col("place") == most)
        left = dealt.where(F.col("batch") > number).groupBy("lang").agg(F.min("n").alias("least")).join(totals, "lang")
        bound = left.select("lang", F.expr("cast(1000 as decimal(38,0)) * n div least").alias("bound"))
        done = last.join(bound, "lang", "left").where(F.coalesce(F.col("score") > F.col("bound"), F.lit(True)))
        settled = stored(done.select("lang"), "settled-languages")
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    all_found = reduce(DataFrame.unionByName, found)
    tied = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = stored(all_found.withColumn("tied", tied).where(F.col("tied") <= most).drop("tied").withColumn("id", F.monotonically_increasing_id()), "best-phrases")
    asked = best.select(F.explode("words").alias("word"))
    said = [texts.mapInArrow(_teller(*keys), "word long, said string") for keys in _sent(asked, most_keys)]
    if not said:
        return best.select("lang", F.lit(0).cast("long").alias("rank"), F.lit("").alias("phrase"), "a", "l", "r", "n", "score")
    said = _passed(reduce(DataFrame.unionByName, said).groupBy("word").agg(F.first("said").alias("said")), "phrase-words")
    spoken = best.select("id", F.posexplode("words").alias("place", "word")).join(said, "word").groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spoken, "id").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
