"""Language ID: bit-sliced Bloom filters over character n-grams.

Learning counts, for every language, the n-grams of its texts over all of them.
A language owns an n-gram if it is at least ``LEAST_RATE`` of all its n-grams and it
uses it at least ``SHARE`` times as often as the language that uses it most. A language
so owns at most ``1 / LEAST_RATE`` n-grams, however much text there is, and the rare
n-grams that ever more text brings do not fill its filter. All filters have one size and lie beside each other:
position p holds a mask with one bit per language, so one read answers for 64
languages, and the AND of a few positions names all languages that own an n-gram.
Predicting counts, per language, how many n-grams of the text it owns, takes off
the false positives to be expected from its filter's fill, and names the largest.

The filter has ``POSITIONS`` positions of one 64-bit mask for each 64 languages:
16 MB, however much text there is, and that is what is collected and broadcast.

Cases: NULL texts and texts without a letter are ``und`` with score 0. A text with
letters but without a known n-gram gets the language with the most learned n-grams,
with score 0. Ties go to the language that is first by name. Rows with a NULL lang
teach nothing; with nothing learned all are ``und``.
Every row gets a result, repeated ones too. Other columns go through; columns named
``lang_pred``, ``score`` or ``known`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.llm.batches import mixed, slices, stored, texts_of

GRAM = 4
POSITION_BITS = 21
POSITIONS = 1 << POSITION_BITS
PROBES = 3
SHARE = 0.1
LEAST_RATE = 1e-6
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """The lower-case form of each letter's code point, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, their rows, and per row whether it has a letter.

    A row is its letters in lower case, each run of others made one blank, with a
    blank before and after. N-grams do not cross rows.
    """
    texts = column.fill_null("").to_pylist()
    joined = np.frombuffer(("\n".join(t.replace("\n", " ") for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(joined == 10)
    low = _letters()[joined]
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([-1], ends))))
    letter = low > 0
    lettered = np.bincount(row[letter], minlength=len(texts)) > 0
    same = np.concatenate(([False], row[1:] == row[:-1]))
    keep = letter | ~np.concatenate(([False], ~letter[:-1])) | ~same
    low, row = low[keep], row[keep]
    # Every row ends in a blank; give it one in front.
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    low, row = np.insert(low, first, 0), np.insert(row, first, row[first])
    if len(low) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    n = len(low) - GRAM + 1
    code = np.zeros(n, np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(16)) ^ low[i : i + n].astype(np.uint64)
    inside = row[:n] == row[GRAM - 1 :]
    return mixed(code[inside]), row[:n][inside], lettered


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        gram, row, _ = grams(texts_of(batch))
        names, lang = np.unique(np.array(texts_of(batch, "lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        order = lang[row]
        for number, name in enumerate(names):
            keys, n = np.unique(gram[order == number], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def _position(gram: Column, probe: int) -> Column:
    return F.shiftrightunsigned(gram, probe * POSITION_BITS).bitwiseAND(F.lit(POSITIONS - 1)).cast("int")


class LanguageFilter:
    """The languages, in order of name, and their filters side by side."""

    def __init__(self, names: list[str], masks: np.ndarray, usual: int):
        self.names, self.masks, self.usual = names, masks, usual
        self.false = np.array(
            [((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES for i in range(len(names))]
        )

    def shares(self, gram: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Per row and language the part of its n-grams that the language owns."""
        out = np.zeros((rows, len(self.names)))
        total = np.maximum(np.bincount(row, minlength=rows), 1)
        place = [((gram >> np.uint64(p * POSITION_BITS)) & np.uint64(POSITIONS - 1)).astype(np.int64) for p in range(PROBES)]
        for word in range(len(self.masks)):
            owners = self.masks[word][place[0]]
            for p in place[1:]:
                owners &= self.masks[word][p]
            for bit in range(min(64, len(self.names) - 64 * word)):
                i = 64 * word + bit
                hits = np.bincount(row, (owners >> np.uint64(bit)) & np.uint64(1), rows)
                out[:, i] = np.clip((hits / total - self.false[i]) / max(1 - self.false[i], 1e-9), 0, 1)
        return out


def learn(labelled: DataFrame) -> LanguageFilter:
    """The filters of all languages of ``text, lang`` rows."""
    spark = labelled.sparkSession
    counts = stored(
        labelled.where("lang is not null")
        .select("text", "lang")
        .mapInArrow(count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "gram-counts",
    )
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    masks = np.zeros((max(1, -(-len(names) // 64)), POSITIONS), np.uint64)
    if names:
        known = spark.createDataFrame([(i, name, float(totals[name])) for i, name in enumerate(names)], "i int, lang string, total double")
        rates = counts.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total"))
        best = rates.where(F.col("rate") >= LEAST_RATE).groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("i", "rate")).alias("all"))
        # A gram has one row per language at most.
        owned = best.select("gram", F.inline(F.filter("all", lambda x: x["rate"] >= SHARE * F.col("best"))))
        bits = (
            owned.select(
                F.explode(F.array(*[_position(F.col("gram"), p) for p in range(PROBES)])).alias("position"),
                F.expr("cast(i div 64 as int)").alias("word"),
                F.expr("shiftleft(1L, i % 64)").alias("bit"),
            )
            .groupBy("word", "position")
            .agg(F.bit_or("bit").alias("mask"))
        )
        for batch in bits.toArrow().to_batches():
            word, position, mask = (batch.column(i).to_numpy() for i in range(3))
            masks[word, position] = mask.view(np.uint64)
    return LanguageFilter(names, masks, max(range(len(names)), key=lambda i: totals[names[i]], default=0))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``known``, all of them.

    ``score`` is the winner's part of all languages' owned shares, ``known`` the
    part of the text's n-grams that the winner owns.
    """
    plain = docs.drop("lang_pred", "score", "known")
    schema = T.StructType(
        [
            *plain.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("known", T.DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.names, UNKNOWN], dtype=object)
        for batch in slices(batches):
            gram, row, lettered = grams(texts_of(batch))
            share = shared.value.shares(gram, row, batch.num_rows)
            if not share.shape[1]:
                share = np.zeros((batch.num_rows, 1))
            best = share.max(axis=1)
            sure = lettered & (best > 0)
            winner = np.where(best > 0, share.argmax(axis=1), shared.value.usual)
            winner = np.where(lettered, winner, len(names) - 1)
            score = np.where(sure, best / np.maximum(share.sum(axis=1), 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[winner], pa.string()), pa.array(score), pa.array(np.where(sure, best, 0.0))],
                schema.names,
            )

    return plain.mapInArrow(predict, schema)
