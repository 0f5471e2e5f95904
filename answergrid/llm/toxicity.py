"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Examples are a sample of at most ``MOST_EXAMPLES`` labelled rows (the smallest hashes
of their ids; the bound is a parameter). The terms are all words of the examples. A term
weighs its inverse document frequency, counted over all texts, times how far it tells the
labels apart: the log-odds of a label where it occurs against those of all examples,
smoothed by ``SMOOTHING`` examples of the base rate, to the power ``SHARPNESS``, and
``LEAST_TELL`` more for any word. So a word tells more the more examples agree, at every number of labels.

The inverted index has, per term, the examples that hold it and their weights, and per
term and block of ``BLOCK`` examples the largest weight. A text reads the postings of its
heaviest terms first. The largest weights bound what its other terms can still add in each
block, ``LEFT`` in all at most: an example that stays below the k-th even so is out, the
cosines of the others are taken from the examples' own terms. While too many are left,
more terms are read, in the end all, so the k nearest are exact. Their votes weigh as much as their cosines:
``score = (sum(cosine * label) + PRIOR * base rate) / (sum(cosine) + PRIOR)``. The base
rate is that of the sample, which is drawn regardless of the label, so scores are rates.
The nearest examples come along as evidence.

The index holds one posting per example and word of it, and is broadcast.

Cases: NULL and empty texts, and texts without a word of the examples, have no neighbour and score the
base rate, below 0.3 unless most examples are toxic. Equal cosines go by the example's
order. Several labels of one id count as toxic if one is, of several texts the first in order is the example;
NULL labels teach nothing; with no labels all
scores are 0. Every row gets a result, repeated rows too. Other columns go through;
columns named ``score`` or ``evidence`` are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.llm.batches import slices, stored, texts_of, words

#: Bound of the sample of labelled rows.
MOST_EXAMPLES = 3_000
SMOOTHING = 3.0
SHARPNESS = 3
LEAST_TELL = 0.01
NEIGHBOURS = 25
BLOCK = 128
#: What the terms not yet read may add to a cosine, round by round, and examples that may be left then.
LEFT = (0.01, 0.001, 0.0)
MOST_LEFT = 8 * NEIGHBOURS
#: Above the rounding of sums.
SLACK = 1e-9
PRIOR = 0.5
#: Answers a task remembers, for copies.
REMEMBERED = 1_000
_EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word the documents of each label that hold it."""
    for batch in slices(batches):
        hashes, first = words(texts_of(batch))
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        word, index = np.unique(hashes, return_inverse=True)
        pairs = np.unique(row * len(word) + index) if len(word) else np.zeros(0, np.int64)
        label = texts_of(batch, "label").to_numpy()[pairs // max(len(word), 1)]
        index = pairs % max(len(word), 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(word.view(np.int64)),
                pa.array(np.bincount(index, minlength=len(word)).astype(np.int64)),
                pa.array(np.bincount(index, label, len(word)).astype(np.int64)),
            ],
            ["word", "n", "toxic"],
        )


def _known(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
    return np.where(terms[place] == hashes, place, -1) if len(terms) else np.full(len(hashes), -1)


def sparse_rows(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each row's terms, in order."""
    hashes, first = words(column)
    index = _known(hashes, terms)
    row = np.repeat(np.arange(len(column)), np.diff(first))[index >= 0]
    both, times = np.unique(row * max(len(terms), 1) + index[index >= 0], return_counts=True)
    return both // max(len(terms), 1), both % max(len(terms), 1), times


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range each comes from."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (begin - np.cumsum(size) + size)[of], of


def _packed(numbers: np.ndarray) -> tuple[str, bytes]:
    small = numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))
    return small.dtype.str, zlib.compress(small.tobytes(), 1)


def _unpacked(kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind).astype(np.int64)


class ExampleIndex:
    """Terms, what each weighs, and block-max posting lists of the examples."""

    def __init__(self, terms: np.ndarray, scale: np.ndarray, ids: list, labels: np.ndarray, triples: tuple):
        example, term, times = triples
        order = np.lexsort((example, term))
        self._build(terms, scale, ids, labels, example[order], times[order], np.bincount(term, minlength=len(terms)))

    def __getstate__(self) -> tuple:
        """What is broadcast: the smallest integers, packed; each process computes the weights and blocks anew."""
        return self.terms, self.scale, self.ids, self.labels, _packed(self.example), _packed(self.times), _packed(self.held)

    def __setstate__(self, state: tuple) -> None:
        self._build(*state[:4], *[_unpacked(*x) for x in state[4:]])

    def _build(self, terms: np.ndarray, scale: np.ndarray, ids: list, labels: np.ndarray, example: np.ndarray, times: np.ndarray, held: np.ndarray) -> None:
        """Times are those of the postings, in order of term and example; each term is held by so many examples."""
        self.terms, self.scale, self.ids, self.labels = terms, scale, ids, labels
        self.example, self.times, self.held = example.astype(np.int32), times, held
        self.base = float(labels.mean()) if len(labels) else 0.0
        term = np.repeat(np.arange(len(terms)), held)
        weight = self.weights(term, times)
        norm = np.sqrt(np.bincount(self.example, weight**2, len(ids)))
        self.weight = weight / norm[self.example] if len(weight) else weight
        self.blocks = max(1, -(-len(ids) // BLOCK))
        #: One entry per term and block that has postings: its block, where they begin, and the largest weight.
        place = term * self.blocks + self.example // BLOCK
        first = np.flatnonzero(np.diff(place, prepend=-1))
        self.block = (place[first] % self.blocks).astype(np.int32)
        self.begin = np.append(np.cumsum(held) - held, len(place))
        self.entries = np.searchsorted(place[first] // self.blocks, np.arange(len(terms) + 1))
        # Above the true weight, so that rounding cannot hide a block.
        most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.most = np.nextafter(most.astype(np.float32), np.float32(2))
        # Every term of the index is held by an example.
        self.top = np.maximum.reduceat(self.most, self.entries[:-1]) if len(first) else np.zeros(0, np.float32)
        #: The same postings by example.
        by_example = np.argsort(self.example, kind="stable")
        self.own_term, self.own_weight = term[by_example].astype(np.int32), self.weight[by_example]
        self.own_begin = np.searchsorted(self.example[by_example], np.arange(len(ids) + 1))
        self.asked = np.zeros(len(terms))

    def weights(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (1 + np.log(times)) * self.scale[term]

    def nearest(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0, and the cosines."""
        order = np.argsort(-weight * self.top[term], kind="stable")
        term, weight = term[order], weight[order]
        adds = weight * self.top[term]
        after = np.append(np.cumsum(adds[::-1])[::-1], 0.0)  # what the terms from the i-th on can add
        total, read = np.zeros(self.blocks * BLOCK), 0
        for left in LEFT:
            stop = int(np.searchsorted(-after, -left)) if left else len(term)
            at, of = _ranges(self.begin[term[read:stop]], self.begin[term[read:stop] + 1])
            total += np.bincount(self.example[at], self.weight[at] * weight[read:stop][of], len(total))
            read = max(read, stop)
            if read == len(term):
                found = np.flatnonzero(total)
                return self._best(found, total[found])
            kth = np.partition(total, -NEIGHBOURS)[-NEIGHBOURS] - SLACK
            if kth <= 0 or np.count_nonzero(total + after[read] >= kth) > 4 * MOST_LEFT:
                continue
            entry, of = _ranges(self.entries[term[read:]], self.entries[term[read:] + 1])
            bounds = np.bincount(self.block[entry], weight[read:][of] * self.most[entry], self.blocks)
            near = np.flatnonzero((total.reshape(self.blocks, BLOCK) + bounds[:, None]).ravel() >= kth)
            near = near[near < len(self.ids)]
            if len(near) <= MOST_LEFT:
                return self._best(near, self._cosines(near, term, weight))
        raise AssertionError("the last round reads all terms")

    def _cosines(self, examples: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        self.asked[term] = weight
        at, of = _ranges(self.own_begin[examples], self.own_begin[examples + 1])
        cosine = np.bincount(of, self.asked[self.own_term[at]] * self.own_weight[at], len(examples))
        self.asked[term] = 0
        return cosine

    def _best(self, examples: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.lexsort((examples, -np.round(cosine, 12)))[:NEIGHBOURS]
        top = top[cosine[top] > 0]
        return examples[top], cosine[top]


def learn(docs: DataFrame, labels: DataFrame, most_examples: int = MOST_EXAMPLES) -> ExampleIndex:
    """The index of labelled examples; ``labels`` has ``doc_id, label``, ``docs`` all texts for the frequencies."""
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    # At most most_examples pairs of numbers.
    sample = stored(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples), "example-ids")
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    examples = examples.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    examples = stored(examples.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "examples")
    counts = examples.select("text", F.col("label").cast("double").alias("label")).mapInArrow(example_words, "word long, n long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    word, n, toxic = (counts.column(c).to_numpy() for c in ("word", "n", "toxic"))
    order = np.argsort(word.view(np.uint64))
    terms, n, toxic = word.view(np.uint64)[order], n[order], toxic[order]
    shared = spark.sparkContext.broadcast(terms)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in slices(batches):
            _, term, _ = sparse_rows(texts_of(batch), shared.value)
            found[:-1] += np.bincount(term, minlength=len(shared.value))
            rows += batch.num_rows
        found[-1] = rows
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen])], ["term", "n"])

    spread = docs.select("text").mapInArrow(count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(len(terms) + 1)
    held[spread.column("term").to_numpy()] = spread.column("n").to_numpy()
    idf = np.log((held[-1] + 1) / (held[:-1] + 1)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, term, times = sparse_rows(texts_of(batch), shared.value)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = [(term[x:y].astype("<i4").tobytes(), times[x:y].astype("<i4").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [texts_of(batch, "doc_id"), texts_of(batch, "label"), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())],
                ["doc_id", "label", "terms", "times"],
            )

    rows = examples.mapInArrow(vectors, "doc_id long, label int, terms binary, times binary").toArrow().sort_by("doc_id")
    labelled = rows.column("label").to_numpy().astype(np.int64)
    term, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<i4") for c in ("terms", "times"))
    example = np.repeat(np.arange(rows.num_rows), [len(x) // 4 for x in rows.column("terms").to_pylist()])
    base = (labelled.sum() + 0.5) / (len(labelled) + 1)
    rate = (toxic + SMOOTHING * base) / (n + SMOOTHING)
    tell = np.abs(np.log(rate / (1 - rate)) - np.log(base / (1 - base))) ** SHARPNESS + LEAST_TELL
    return ExampleIndex(terms, idf * tell, rows.column("doc_id").to_pylist(), labelled, (example, term.astype(np.int64), times))


def score_toxicity(docs: DataFrame, index: ExampleIndex) -> DataFrame:
    """The documents with ``score`` and ``evidence``, the three nearest examples."""
    plain = docs.drop("score", "evidence")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", _EVIDENCE)])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ExampleIndex = shared.value

        @lru_cache(maxsize=REMEMBERED)
        def found(term: bytes, weight: bytes) -> tuple[np.ndarray, np.ndarray]:
            return own.nearest(np.frombuffer(term, np.int64), np.frombuffer(weight))

        for batch in slices(batches):
            row, term, times = sparse_rows(texts_of(batch), own.terms)
            weight = own.weights(term, times)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            scores, evidence = [], []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                best, cosine = np.zeros(0, np.int64), np.zeros(0)
                if b > a:
                    best, cosine = found(term[a:b].tobytes(), (weight[a:b] / np.sqrt((weight[a:b] ** 2).sum())).tobytes())
                scores.append(float((cosine @ own.labels[best] + PRIOR * own.base) / (cosine.sum() + PRIOR)))
                evidence.append([{"doc_id": own.ids[i], "cosine": float(c), "label": int(own.labels[i])} for i, c in zip(best[:3], cosine[:3], strict=True)])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, kind)], schema.names)

    return plain.mapInArrow(score, schema)
