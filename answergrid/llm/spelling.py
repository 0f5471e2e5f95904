"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

1. Tasks count the words of their texts; Spark adds the counts up. The words that reach
   ``LEAST_COUNT`` are a written table.
2. The letters of these words are dealt into ``GROUPS`` groups of about equal use. A word
   is the vector of how many letters of each group it has, and the trie has one level per
   group: a word's path is its counts. An inserted letter makes one count larger by one, a
   deleted letter one smaller, a replaced one both or neither. So whoever is one edit away
   is found by a walk that may be one above and one below the own counts.
3. The top levels of the trie are dealt out as Spark groups: a word goes to its own node,
   and asks at every node within the budget, ``t * t + t + 1`` of them for t levels. There
   are as many levels as it takes for no node to exceed ``NODE_WORDS`` words, at most
   ``MOST_LEVELS``; larger nodes are dealt into blocks of that size, and what asks at one
   block into parts of ``NODE_ASKERS``, so no task gets more than one of each.
4. A task sorts its words by their vectors, which is the trie, and walks it depth first
   with all askers at once: each child keeps those whose budget allows its count. At a leaf
   askers meet words. A word of six letters has its first or last three untouched by one
   edit, which leaves few pairs to be verified letter by letter.
5. What a task gives out per asker is a count and the most frequent near word, not pairs.
   Forms are followed to their roots by doubling.

Cases: NULL text has no words; a NULL doc_id is an empty text where runs are altered. Every
row counts, repeated rows too. Words of any length are whole; words of more than ``WIDTH``
letters are verified by plain comparison. Columns but ``doc_id`` and ``text`` are not looked
at. An empty table gives an empty result. A shorter least length than six is an error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergrid.llm.batches import slices, stored, texts_of

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form occurs so many times as often as its variant.
RATIO = 5
#: One run in so many loses a letter.
ALTERED = 199
GROUPS = 12
NODE_WORDS = 1 << 14
NODE_ASKERS = 1 << 16
MOST_LEVELS = 6
WIDTH = 48
#: Different words that a task holds before it gives their counts out.
HELD_WORDS = 1 << 18
#: Pairs that are verified at once.
PAIRS = 1 << 18
#: Characters of UTF-8 that are neither ASCII nor U+00C0 to U+00FF.
_FOREIGN = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")


def word_counter(least_letters: int, altered: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    # Letters of ASCII (lower-cased before) and U+00C0 to U+00FF; a letter has one or two bytes.
    long_run = re.compile(rb"[a-z\xc3\x80-\xbf]{%d,}" % least_letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if n and len(w) - w.count(b"\xc3") >= least_letters}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()).cast(pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            ids = texts_of(batch, "doc_id").cast(pa.string()).fill_null("").to_pylist()
            texts = texts_of(batch).cast(pa.binary()).to_pylist()
            for doc, text in zip(ids, texts, strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                # bytes.lower changes A-Z alone.
                runs = long_run.findall(_FOREIGN.sub(b" ", (text or b"").lower()))
                counts.update(runs)
                hit = {r for r in set(runs) if zlib.crc32(r, start) % altered == 0}
                for run, times in Counter(r for r in runs if r in hit).items() if hit else ():
                    letters = run.decode()
                    gone = zlib.crc32(run, start) % len(letters)
                    counts[run] -= times
                    counts[(letters[:gone] + letters[gone + 1 :]).encode()] += times
            if len(counts) >= HELD_WORDS:
                yield given()
        yield given()

    return count


def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter("".join(texts_of(batch, "word").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["letter", "n"])


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """The group of each code point below 256: the most used letter goes to the group used least so far.

    The alphabet has 90 letters, so the counts are few.
    """
    found = words.select("word").mapInArrow(count_letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    group, used = np.zeros(256, np.int64), np.zeros(groups)
    for r in sorted(found, key=lambda r: (-r["n"], r["letter"])):
        group[ord(r["letter"])] = used.argmin()
        used[used.argmin()] += r["n"]
    return group


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, one after the other, and where each word's begin (one more at the end)."""
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def vectors(words: list[str], group: np.ndarray, groups: int) -> np.ndarray:
    """One row per word: how many letters of each group it has."""
    letters, first = letters_of(words)
    row = np.repeat(np.arange(len(words)), np.diff(first))
    return np.bincount(row * groups + group[letters], minlength=len(words) * groups).reshape(-1, groups).astype(np.int32)


def asks(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes that words ask at: their own counts with at most one more and one less. Rows, and the nodes."""
    levels, every = own.shape[1], np.arange(len(own))
    changes = [()] + [((i, d),) for i in range(levels) for d in (1, -1)]
    changes += [((i, 1), (j, -1)) for i in range(levels) for j in range(levels) if i != j]
    for change in changes:
        node = own.copy()
        for at, by in change:
            node[:, at] += by
        there = (node >= 0).all(axis=1)
        yield every[there], node[there]


def _node(counts: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(counts, "<i4")], pa.binary())


def walk(member: np.ndarray, asker: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first search of all askers in the trie of the members' vectors: askers and members that meet at a leaf.

    ``member`` is sorted by its columns, so a node is a range of its rows.
    """
    levels = member.shape[1]
    every = np.arange(len(asker))
    stack = [(0, 0, len(member), every, np.ones(len(asker), bool), np.ones(len(asker), bool))]
    while stack:
        level, low, high, who, more, less = stack.pop()
        if not len(who) or low == high:
            continue
        if high - low == 1 or level == levels:
            # One word is left on this path: all other levels at once.
            off = asker[who, level:] - member[low, level:]
            fits = (np.maximum(off, 0).sum(1) <= more) & (np.maximum(-off, 0).sum(1) <= less)
            who = who[fits]
            yield np.repeat(who, high - low), np.tile(np.arange(low, high), len(who))
            continue
        own = asker[who, level]
        column = member[low:high, level]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [high - low]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            off = own - column[a]
            fits = (off == 0) | ((off == 1) & more) | ((off == -1) & less)
            stack.append((level + 1, low + a, low + b, who[fits], more[fits] & (off[fits] != 1), less[fits] & (off[fits] != -1)))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))  # noqa: B905
    return a[same + 1 :] == b[same + (len(a) == len(b)) :]


class Letters:
    """Words as rows of letters, for many comparisons at once."""

    def __init__(self, words: list[str]):
        self.words = words
        letters, first = letters_of(words)
        self.size = np.diff(first)
        self.rows = np.zeros((len(words), WIDTH + 1), np.uint8)
        row = np.repeat(np.arange(len(words)), self.size)
        column = np.arange(len(letters)) - first[:-1][row]
        kept = column < WIDTH
        self.rows[row[kept], column[kept]] = letters[kept]
        code = letters.astype(np.int64)
        self.head = self._three(code, first[:-1])
        self.tail = self._three(code, first[1:] - 3)

    def _three(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (code[at] << 16) | (code[at + 1] << 8) | code[at + 2] if len(at) else at

    def near(self, mine: np.ndarray, other: Letters, theirs: np.ndarray) -> np.ndarray:
        """Marks the pairs that are one edit apart."""
        maybe = (self.head[mine] == other.head[theirs]) | (self.tail[mine] == other.tail[theirs])
        maybe &= np.abs(self.size[mine] - other.size[theirs]) <= 1
        left = np.flatnonzero(maybe)
        out = np.zeros(len(mine), bool)
        for begin in range(0, len(left), PAIRS):
            at = left[begin : begin + PAIRS]
            i, j = mine[at], theirs[at]
            longer = self.size[i] >= other.size[j]
            a = np.where(longer[:, None], self.rows[i], other.rows[j])
            b = np.where(longer[:, None], other.rows[j], self.rows[i])
            same = self.size[i] == other.size[j]
            differs = a != b
            first = differs.argmax(1)
            # Beyond the first difference, the longer word without that letter is the shorter one.
            behind = np.arange(WIDTH) >= first[:, None]
            shifted = ~((a[:, 1:] != b[:, :-1]) & behind).any(1)
            out[at] = np.where(same, differs.sum(1) == 1, shifted)
            for k in np.flatnonzero(np.maximum(self.size[i], other.size[j]) > WIDTH):
                out[at[k]] = one_edit(self.words[i[k]], other.words[j[k]])
        return out


def _searcher(group: np.ndarray, groups: int):
    def search(table: pa.Table) -> pa.Table:
        asking = table.column("asks").to_numpy()
        words = np.array(table.column("word").to_pylist(), dtype=object)
        n = table.column("n").to_numpy()
        members, askers = words[~asking].tolist(), words[asking].tolist()
        vector = vectors(members, group, groups)
        order = np.lexsort(vector.T[::-1])
        members, times, vector = [members[i] for i in order], n[~asking][order], vector[order]
        known, own = Letters(members), Letters(askers)
        # The rank of each member: the most frequent first, of equal ones the first by code points.
        rank = np.empty(len(members), np.int64)
        rank[sorted(range(len(members)), key=lambda i: (-times[i], members[i]))] = np.arange(len(members))
        found, best = np.zeros(len(askers), np.int64), np.full(len(askers), len(members), np.int64)
        held, size = [], 0

        def verify() -> None:
            nonlocal size
            if held:
                mine, theirs = (np.concatenate(x) for x in zip(*held, strict=True))
                near = own.near(mine, known, theirs)
                found[:] += np.bincount(mine[near], minlength=len(askers))
                np.minimum.at(best, mine[near], rank[theirs[near]])
            held.clear()
            size = 0

        for mine, theirs in walk(vector, vectors(askers, group, groups)):
            for begin in range(0, len(mine), 16 * PAIRS):
                held.append((mine[begin : begin + 16 * PAIRS], theirs[begin : begin + 16 * PAIRS]))
                size += len(held[-1][0])
                if size >= PAIRS:
                    verify()
        verify()
        by_rank = np.argsort(rank)
        hit = np.flatnonzero(found)
        named = by_rank[best[hit]].tolist()
        columns = [
            pa.array([askers[i] for i in hit], pa.string()),
            pa.array(found[hit]),
            pa.array([members[i] for i in named], pa.string()),
            pa.array(times[named] if named else [], pa.int64()),
        ]
        return pa.table(columns, names=["word", "n_near", "best", "best_n"])

    return search


def _levels(words: DataFrame, group: np.ndarray, node_words: int, most: int) -> tuple[int, DataFrame]:
    """How many levels are dealt out, and the words at their nodes."""

    def placed(levels: int) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = vectors(texts_of(batch, "word").to_pylist(), group, GROUPS)
                yield pa.RecordBatch.from_arrays([*batch.columns, _node(own[:, :levels])], [*batch.schema.names, "node"])

        return words.select("word", "n").mapInArrow(place, "word string, n long, node binary")

    for levels in range(1, most):
        largest = placed(levels).groupBy("node").count().agg(F.max("count")).first()[0]
        if (largest or 0) <= node_words:
            return levels, placed(levels)
    return most, placed(most)


def near_words(words: DataFrame, node_words: int = NODE_WORDS, node_askers: int = NODE_ASKERS, most_levels: int = MOST_LEVELS) -> DataFrame:
    """``word, n_near, best, best_n``: words with near ones, how many, and the most frequent of them.

    ``words`` has ``word, n``, each word once.
    """
    group = letter_groups(words, GROUPS)
    levels, at_node = _levels(words, group, node_words, most_levels)
    sizes = stored(at_node.groupBy("node").agg(F.count("*").alias("n")), "trie-nodes")

    def ask_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Who is at a node asks where that node does."""
        for batch in batches:
            own = np.frombuffer(b"".join(texts_of(batch, "node").to_pylist()), "<i4").reshape(-1, levels)
            for rows, node in asks(own):
                yield pa.RecordBatch.from_arrays([_node(node), texts_of(batch, "n").take(pa.array(rows))], ["node", "n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors(texts_of(batch, "word").to_pylist(), group, GROUPS)
            for rows, node in asks(own[:, :levels]):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, _node(node)], ["word", "n", "node"])

    askers = sizes.mapInArrow(ask_nodes, "node binary, n long").groupBy("node").agg(F.sum("n").alias("askers"))
    many = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    parts = sizes.join(askers, "node").select("node", many("n", node_words).alias("blocks"), many("askers", node_askers).alias("parts"))
    parts = stored(parts, "trie-parts")

    def dealt(df: DataFrame, own: Column, copies: Column, asks: bool) -> DataFrame:
        """Every block of words meets every part of what asks."""
        spread = F.pmod(F.xxhash64("word"), own).cast("int")
        every = F.explode(F.sequence(F.lit(0), copies - 1))
        named = ("part", "block") if asks else ("block", "part")
        return df.withColumn(named[0], spread).withColumn(named[1], every).select("node", "block", "part", F.lit(asks).alias("asks"), "word", "n")

    members = dealt(at_node.join(parts, "node"), F.col("blocks"), F.col("parts"), False)
    asked = words.select("word", "n").mapInArrow(ask, "word string, n long, node binary").join(parts, "node")
    met = members.unionByName(dealt(asked, F.col("parts"), F.col("blocks"), True)).groupBy("node", "block", "part")
    found = met.applyInArrow(_searcher(group, GROUPS), "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``word, form`` lead; each round doubles the steps taken."""
    steps = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = stored(steps.join(ahead, "root").select("word", "root", "next"), "roots")
        steps = farther.select("word", F.col("next").alias("root"))
        if farther.where("root <> next").isEmpty():
            return steps


def spelling_variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, altered: int = ALTERED
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of all texts.

    ``form`` is the most frequent near word if it occurs at least ``ratio`` times as often.
    """
    if least_letters < 6:
        raise ValueError("one edit leaves the first or last three letters of words of six letters or more")
    counted = docs.select("doc_id", "text").mapInArrow(word_counter(least_letters, altered), "word string, n long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "spelling-words")
    near = near_words(words)
    taken = F.col("best_n") >= ratio * F.col("n")
    named = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")
    )
    named = stored(named, "spelling-forms")
    return named.join(roots(named), "word")
