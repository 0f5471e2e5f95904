"""MinHash near-dedup: consistent weighted sampling over TF-IDF word shingles.

A document is the multiset of its shingles of five words (a shorter one is a single
shingle). A shingle weighs ``1 + ln(times)`` times the mean of its words' inverse
document frequencies, ``1 + ln((N + 1) / (df + 1)) / ln(N + 2)``, with df counted over
all documents in ``BUCKETS`` hash buckets of words: a table of fixed size.

1. Documents with the same words in the same order are one text from here on.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per text: two
   texts agree on one with the probability of their weighted Jaccard similarity. The
   random numbers of a shingle come from its hash, quantiles from tables of 65,536.
   ROWS samples make a band, and texts that agree on a band are candidates.
3. Every bucket's members are verified against its smallest member: the exact
   weighted Jaccard similarity of the whole texts must reach the threshold. What
   passes is connected, with labels that travel along links.
4. Links that this leaves out can only join two classes. So buckets with members of
   several classes are dealt into blocks of bounded size, and each pair of blocks is
   compared in a task, by the same exact similarity over an index of its shingles.
   A task gives out the links that join classes, never pairs. Then classes are
   connected again. Copies are not expanded into pairs.

A pair of similarity 0.8 shares a band with a probability above 0.998.

Cases: NULL text is empty; texts without words are one text if their bytes are equal.
Repeated rows are copies. A NULL doc_id takes part; a class is named by its smallest
doc_id that is not NULL, or NULL if it has none. An empty table gives an empty result.
Other columns go through, whatever their names; of rows with one id and the same words any
one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.functions.names import free_names
from answergrid.llm.batches import mixed, rolling, slices, stored, text_bytes, texts_of, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 4
BLOCK_ROWS = 256
BLOCK_CHARS = 4_000_000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS

_QUANTILES = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)
_LOW = np.uint64(0xFFFF)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the documents of this task that have a word in it; bucket -1 counts all."""
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches):
        hashes, first = words(texts_of(batch))
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        there = np.unique(row * BUCKETS + _bucket(hashes)) % BUCKETS
        total += np.bincount(there, minlength=BUCKETS)
        rows += batch.num_rows
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], ["bucket", "n"]
    )


def word_weights(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency of each bucket, between 1 and 2."""
    counts = docs.select("text").mapInArrow(count_words, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    total = float(n[bucket < 0].sum())
    return 1 + np.log((total + 1) / (df + 1)) / np.log(total + 2)


def vectors(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row (sorted), their weights, each row's first, and the words behind them."""
    hashes, first = words(column)
    sizes = np.diff(first)
    at, row = windows(first, SHINGLE)
    shingle = rolling(hashes, SHINGLE)[at]
    own = idf[_bucket(hashes)]
    weight = sum(own[at + i] for i in range(SHINGLE)) / SHINGLE if len(at) else np.zeros(0)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        few = [hashes[first[i] : first[i + 1]] for i in short]
        shingle = np.append(shingle, np.array([rolling(x, len(x))[0] for x in few], np.uint64))
        weight = np.append(weight, [own[first[i] : first[i + 1]].mean() for i in short])
        row = np.append(row, short)
    order = np.lexsort((shingle, row))
    shingle, weight, row = shingle[order], weight[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1]))) if len(row) else [])
    times = np.diff(np.append(new, len(row)))
    return shingle[new], weight[new] * (1 + np.log(times)), np.searchsorted(row[new], np.arange(len(sizes) + 1)), hashes, first


def text_keys(column: pa.Array, hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of the words of each row, or of its bytes if it has no words."""
    data, offsets = text_bytes(column)
    return [
        xxhash.xxh3_128_digest(hashes[a:b].tobytes() if b > a else b"\0" + data[c:d].tobytes())
        for a, b, c, d in zip(first[:-1], first[1:], offsets[:-1], offsets[1:], strict=True)
    ]


def samples(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` consistent weighted samples of each row that has shingles, as 64-bit hashes."""
    begin, rows = first[:-1], len(first) - 1
    out = np.zeros((rows, count), np.uint64)
    if not len(shingle):
        return out
    log_weight = np.log(weight).astype(np.float32)
    sizes = np.diff(first)
    row = np.repeat(np.arange(rows), sizes)
    for j in range(count):
        bits = mixed(shingle, j)
        r = _QUANTILES[bits & _LOW] + _QUANTILES[(bits >> np.uint64(16)) & _LOW]
        c = _QUANTILES[(bits >> np.uint64(32)) & _LOW] + _QUANTILES[bits >> np.uint64(48)]
        beta = ((bits * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_weight / r + beta)
        value = np.log(c) - r * (t - beta + 1)
        least = np.minimum.reduceat(value, np.minimum(begin, len(value) - 1))
        at = np.flatnonzero(value == least[row])
        # Of equal values the last in order stays; the order is by hash, so it does not depend on the row.
        out[row[at], j] = mixed(bits[at] ^ t[at].astype(np.int64).view(np.uint64))
    return out


_SIGNED = "doc_id long, key binary, weight double, bands array<long>"


def _sign(shared: Broadcast):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = texts_of(batch)
            shingle, weight, first, hashes, first_word = vectors(column, shared.value)
            drawn = samples(shingle, weight, first, BANDS * ROWS)
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            for i in range(ROWS):
                bands = mixed(bands, i) ^ drawn[:, i::ROWS]
            total = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(first)), weight, batch.num_rows)
            empty = np.diff(first) == 0
            lists = bands.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    texts_of(batch, "doc_id").cast(pa.int64()),
                    pa.array(text_keys(column, hashes, first_word), pa.binary()),
                    pa.array(total, pa.float64()),
                    pa.array([[] if e else x for e, x in zip(empty, lists, strict=True)], pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "weight", "bands"],
            )

    return sign


def with_key(docs: DataFrame, name: str) -> DataFrame:
    """The documents with the key of their words."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = texts_of(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(text_keys(column, *words(column)), pa.binary())], schema.names
            )

    return docs.mapInArrow(add, schema)


def similarity(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts."""
    (xs, xw, xf, *_), (ys, yw, yf, *_) = vectors(a, idf), vectors(b, idf)
    out = np.zeros(len(a))
    for i in range(len(a)):
        x, wx = xs[xf[i] : xf[i + 1]], xw[xf[i] : xf[i + 1]]
        y, wy = ys[yf[i] : yf[i + 1]], yw[yf[i] : yf[i + 1]]
        if not len(x) or not len(y):
            continue
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        shared = np.minimum(wx, wy[at])[y[at] == x].sum()
        out[i] = shared / (wx.sum() + wy.sum() - shared)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float, name: str) -> DataFrame:
    """The pairs ``a, b`` of keys whose texts are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "a_text"), "b_text"):
            near = similarity(texts_of(batch, "a_text"), texts_of(batch, "b_text"), shared.value) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(texts.toDF("b", "b_text"), "b").join(texts.toDF("a", "a_text"), "a")
    return stored(both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a binary, b binary"), name)


def components(links: DataFrame) -> DataFrame:
    """``key, class``: of every linked key the smallest key that links lead to."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("class")), "labels")
    while True:
        sent = both.join(labels.toDF("a", "class"), "a").select(F.col("b").alias("key"), "class")
        least = labels.unionByName(sent).groupBy("key").agg(F.min("class").alias("class"))
        least = stored(least, "labels")
        ahead = least.toDF("class", "next")
        jumped = least.join(ahead, "class", "left").select("key", F.least("class", F.coalesce("next", "class")).alias("class"))
        jumped = stored(jumped, "labels")
        changed = jumped.join(labels.toDF("key", "old"), "key").where("class <> old")
        if changed.isEmpty():
            return jumped
        labels = jumped


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, keeper, key``: one row per document with its class.

    ``class_id`` is the smallest doc_id of the class and ``keeper`` marks the rows of the
    text that stands for it.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(word_weights(plain))
    signed = stored(plain.mapInArrow(_sign(shared), _SIGNED), "signatures")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))).alias("first")
    texts_seen = signed.groupBy("key").agg(
        smallest, F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands")
    )
    distinct = stored(texts_seen.select("key", F.col("first.doc_id").alias("doc_id"), "weight", "bands"), "texts")
    members = distinct.select("key", "weight", F.posexplode("bands").alias("band", "value"))
    buckets = stored(
        members.groupBy("band", "value")
        .agg(F.min(F.struct("key", "weight")).alias("pivot"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "buckets",
    )
    in_buckets = stored(members.join(buckets, ["band", "value"]), "bucket-members")
    alike = F.least("weight", "pivot.weight") >= F.greatest("weight", "pivot.weight") * (threshold - 1e-9)
    stars = stored(
        in_buckets.where((F.col("key") != F.col("pivot.key")) & alike)
        .select(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
        .distinct(),
        "star-pairs",
    )
    asked = in_buckets.select("key").distinct().join(distinct.select("key", "doc_id"), "key")
    texts = _texts(plain, asked)
    links = _verified(stars, texts, shared, threshold, "star-links")
    classes = components(links)
    more = _across(in_buckets, classes, texts, shared, threshold)
    if not more.isEmpty():
        classes = components(links.unionByName(more))
    named = distinct.select("key", "doc_id").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    heads = named.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))).alias("head")
    )
    to_class = stored(
        named.join(heads, "class").select(
            "key", F.col("head.doc_id").alias("class_id"), (F.col("head.key") == F.col("key")).alias("first"), F.col("doc_id").alias("first_id")
        ),
        "classes",
    )
    return signed.select("doc_id", "key").join(to_class, "key").select(
        "doc_id", "class_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("keeper"), "key"
    )


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, text`` of the keys asked for, each from the row of its smallest doc_id."""
    found = docs.withColumnRenamed("doc_id", "id").join(
        asked.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id"))
    )
    keyed = with_key(found.select("key", "text"), "own_key").where("key = own_key")
    return stored(keyed.groupBy("key").agg(F.any_value("text").alias("text")), "candidate-texts")


def links_between(table: pa.Table, idf: np.ndarray, threshold: float) -> pa.Table:
    """Links that join the classes of a few texts: the similar pairs of different classes, but for those that lead where others do."""
    keys, classes = table.column("key").to_pylist(), table.column("class").to_pylist()
    shingle, weight, first, *_ = vectors(table.column("text").combine_chunks(), idf)
    sizes, n = np.diff(first), len(keys)
    total = np.bincount(np.repeat(np.arange(n), sizes), weight, n)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(shingle, kind="stable")
    postings, owners, weights = shingle[order], row[order], weight[order]
    low, high = np.searchsorted(postings, shingle, "left"), np.searchsorted(postings, shingle, "right")
    number = {c: i for i, c in enumerate(dict.fromkeys(classes))}
    own = np.array([number[c] for c in classes])
    head = list(range(len(number)))

    def top(c: int) -> int:
        while head[c] != c:
            head[c] = c = head[head[c]]
        return c

    largest = np.bincount(own, minlength=len(number)).argmax() if n else 0
    found = []
    for i in np.flatnonzero(own != largest):
        spans = slice(first[i], first[i + 1])
        lengths = high[spans] - low[spans]
        at = np.repeat(low[spans], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.bincount(owners[at], np.minimum(weights[at], np.repeat(weight[spans], lengths)), n)
        near = shared >= threshold * (total[i] + total - shared) - 1e-12
        for j in np.flatnonzero(near & (own != own[i]) & (total > 0)):
            x, y = top(own[i]), top(own[j])
            if x != y:
                head[x] = y
                found.append((keys[i], keys[j]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


def _across(in_buckets: DataFrame, classes: DataFrame, texts: DataFrame, shared: Broadcast, threshold: float) -> DataFrame:
    """Links between different classes that share a bucket.

    The members of a bucket with several classes are dealt into blocks of about
    ``BLOCK_ROWS`` texts and ``BLOCK_CHARS`` characters; each pair of blocks is compared
    in a task of its own, which gives out links, not pairs.
    """
    named = in_buckets.select("band", "value", "key").join(classes, "key", "left")
    sized = texts.select("key", F.length("text").alias("chars"))
    named = stored(named.join(sized, "key").withColumn("class", F.coalesce("class", "key")), "bucket-classes")
    several = (
        named.groupBy("band", "value")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
        .where("low <> high")
        .select("band", "value", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("chars") / BLOCK_CHARS)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = named.join(several, ["band", "value"]).withColumn("own", own).withColumn("other", other)
    dealt = dealt.select(
        "band", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "key", "class"
    )

    def compare(table: pa.Table) -> pa.Table:
        return links_between(table, shared.value, threshold)

    grouped = dealt.join(texts, "key").select("band", "value", "x", "y", "key", "class", "text").groupBy("band", "value", "x", "y")
    return stored(grouped.applyInArrow(compare, "a binary, b binary"), "class-links")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: of each class the row of its smallest doc_id."""
    kept = near_duplicates(docs, threshold).where("keeper").select("doc_id", "key").distinct()
    key, own, its_key = free_names(docs.columns, "key", "kept_id", "kept_key")
    kept = stored(kept, "kept").toDF(own, its_key)
    found = with_key(docs, key).join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(its_key)))
    return found.dropDuplicates([own, its_key]).select(*docs.columns)
