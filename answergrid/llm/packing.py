"""Packing: token sequences of bounded length, cut by dynamic programming in the order of the documents.

A document is its token ids and an end id. The documents of a task, one after the other,
are one stream of ids, which is cut into sequences of at most ``SEQUENCE`` ids. A sequence
is padded to that length, unless its own length is a power of two. Cuts may lie

- at the end of a document, for nothing,
- at the end of a sentence, for ``SENTENCE_CUT``,
- where neither is near, every ``GRID`` ids inside a sentence, for ``INNER_CUT``,

and the cuts chosen have the least sum of padding and these penalties, all in ids. With
``cost[j] = penalty[j] + min(cost[i] + SEQUENCE - (at[j] - at[i]))`` over the cuts i at
most ``SEQUENCE`` before j, the least ``cost[i] + at[i]`` of a sliding window is wanted: a
monotone queue holds it, so a cut costs the same however long sequences are. For powers of
two the one cut that far before is looked up as well.

A stream is worked off in stretches of ``STRETCH`` ids: the cuts of a stretch are exact for
it, all sequences but its last few are given out and the rest begins the next stretch. So
a task holds one stretch and one text. Nothing is shuffled: a task's last sequence is the
only one that stays open for want of documents.

Words repeat, so ids are kept per blank-separated part of a text: the tokenizer drops
white space and no token or normal form crosses it. Parts of Latin letters are looked up in
lower case and their last punctuation apart; in the tokenizer's spelling of each letter
they go to its model directly.

Cases: NULL and empty texts are their end id alone. Every row is a document, with repeated
or NULL ids too. A text longer than a sequence, or than a stretch, is cut into pieces like
any other. Columns but ``doc_id`` and ``text`` are not looked at. An empty table gives no
piece. ``sequence_id`` is the task's number times 2^33 and a count: unique in one result,
and the same when a task runs again.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from answergrid.llm.batches import slices, texts_of

SEQUENCE = 2048
END = 1
SENTENCE_CUT = 2
INNER_CUT = 10
GRID = 32
STRETCH = 1 << 18
#: Text whose parts are looked up at once.
READ_BYTES = 1 << 22
#: Sequences at the end of a stretch that the next one cuts anew.
RECUT = 4
#: Words and other parts of texts whose ids a process remembers.
REMEMBERED = 1 << 20
TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
#: A word of Latin letters and the ASCII punctuation after it.
_PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_SENTENCE_END = re.compile(r"[.!?]+(</w>)?\Z")


class Ids:
    """The token ids of texts, remembered by part."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        self.words: dict[str, bytes] = {"": b""}
        self.spelling = str.maketrans({c: self._spelled(c) for c in LATIN.lower()})
        self.latin = frozenset(LATIN.lower())
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size() + END + 1, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends_sentence[number] = bool(_SENTENCE_END.search(token))

    def _spelled(self, letter: str) -> str:
        [(spelled, _)] = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter))
        return spelled

    def _encoded(self, parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        found = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        ids, owner = np.array(found.ids, np.uint32), np.array(found.word_ids, np.int64)
        cut = np.searchsorted(owner, np.arange(len(parts) + 1)).tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words and other parts."""
        tokenize, plain, others = self.tokenizer.model.tokenize, self.latin.issuperset, []
        for word in words:
            if plain(word):
                self.words[word] = array("I", [t.id for t in tokenize(word.translate(self.spelling))]).tobytes()
            else:
                others.append(word)
        self.words.update(zip(others, self._encoded(others), strict=True))

    def _packed(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each of the parts' distinct words, one after the other, how many each has, and the parts' words."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.words.get, distinct))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        if fresh:
            if len(self.words) > REMEMBERED:
                self.words = {"": b""}
            self._learn([distinct[i] for i in fresh])
            for i in fresh:
                found[i] = self.words[distinct[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), size, coded.indices.to_numpy()

    def _by_part(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, one part after the other, and how many each has."""
        plain = pc.extract_regex(parts, _PLAIN)
        word = pc.coalesce(pc.utf8_lower(pc.struct_field(plain, "word")), parts)
        tail = pc.struct_field(plain, "tail").fill_null("")
        ids, size, code = self._packed(pa.concat_arrays([word, tail]))
        code = code.reshape(2, -1).T.ravel()
        return ids[_ranges(np.cumsum(size) - size, size, code)], size[code].reshape(-1, 2).sum(axis=1)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id of each text, and where each text's begin (one more at the end)."""
        split = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
        counts = pc.list_value_length(split).to_numpy()
        coded = split.flatten().dictionary_encode()
        ids, size = self._by_part(coded.dictionary)
        part = coded.indices.to_numpy()
        place = np.concatenate(([0], np.cumsum(size[part])))
        text_ends = place[np.cumsum(counts)]
        out = np.insert(ids[_ranges(np.cumsum(size) - size, size, part)], text_ends, END)
        return out, np.concatenate(([0], text_ends + np.arange(1, len(counts) + 1)))


def _ranges(begin: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The numbers of the chosen ranges, one range after the other."""
    sizes = size[chosen]
    return np.arange(sizes.sum()) + np.repeat(begin[chosen] - np.cumsum(sizes) + sizes, sizes)


def candidates(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, sentence: int, inner: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie (0 and the end too) and what each costs; ``ends`` are the documents' ends."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[np.flatnonzero(ends_sentence[ids]) + 1] = sentence
    cost[ends] = 0
    cost[[0, len(ids)]] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    more = (gap - 1) // grid
    inside = np.repeat(at[:-1], more) + grid * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    cost[inside] = inner
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, sequence: int) -> list[int]:
    """The places of the cuts whose padding and penalties add up to the least; 0 and the last place are cuts."""
    place, fee = at.tolist(), penalty.tolist()
    number = np.full(place[-1] + 1, -1, np.int64)
    number[at] = np.arange(len(at))
    pairs = []  # cuts a power of two apart
    for power in (1 << k for k in range(sequence.bit_length()) if 1 << k <= sequence):
        first = int(np.searchsorted(at, power))
        earlier = number[at[first:] - power]
        hit = np.flatnonzero(earlier >= 0)
        pairs.append((hit + first, earlier[hit]))
    later, earlier = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(later, kind="stable")
    apart = earlier[order].tolist()
    slot = np.searchsorted(later[order], np.arange(len(at) + 1)).tolist()
    cost, before = [0], [0]
    queue = deque([(0, 0, 0)])  # cost + place, place, number; the least first
    for j in range(1, len(place)):
        here = place[j]
        while queue[0][1] < here - sequence:
            queue.popleft()
        least, number = queue[0][0] + sequence - here, queue[0][2]
        for i in apart[slot[j] : slot[j + 1]]:
            if cost[i] < least:
                least, number = cost[i], i
        total = least + fee[j]
        cost.append(total)
        before.append(number)
        total += here
        while queue and queue[-1][0] >= total:
            queue.pop()
        queue.append((total, here, j))
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(place[j])
        j = before[j]
    return [0, *reversed(cuts)]


def pack(docs: DataFrame, sequence: int = SEQUENCE, sentence_cut: int = SENTENCE_CUT, inner_cut: int = INNER_CUT, tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """The pieces of all documents and where they lie in the sequences.

    ``start`` counts the document's ids before the piece, ``ids`` are little-endian unsigned
    32-bit numbers, ``offset`` is the place in the sequence and ``sequence_length`` the
    sequence's length with its padding. ``tokenizer`` is the path of a vocabulary file.
    """
    grid = max(1, min(GRID, sequence))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(tokenizer or public_tokenizers.path(TOKENIZER))
        numbers = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        ids, docs_of = np.zeros(0, np.uint32), []  # docs: [id, ids before this stretch, ids in it, all ids]

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs_of, numbers
            ends = np.cumsum([d[2] for d in docs_of])
            at, penalty = candidates(ids, ends[:-1], known.ends_sentence, sentence_cut, inner_cut, grid)
            cuts = best_cuts(at, penalty, sequence)
            if not last:
                cuts = cuts[: max(len(cuts) - RECUT, 2)]
            stop = cuts[-1]
            edges = np.union1d(cuts, ends[ends < stop])
            doc = np.searchsorted(ends, edges[:-1], "right")
            window = np.searchsorted(cuts, edges[:-1], "right") - 1
            begins, cut = np.concatenate(([0], ends[:-1])), np.array(cuts)
            before = np.array([d[1] for d in docs_of])
            whole = np.diff(cut)
            full = np.where((whole & (whole - 1)) == 0, whole, sequence)
            columns = [
                pa.array([docs_of[d][0] for d in doc.tolist()], pa.int64()),
                pa.array(edges[:-1] - begins[doc] + before[doc]),
                pa.array(np.diff(edges)),
                pa.array([ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                pa.array(np.array([d[3] for d in docs_of])[doc]),
                pa.array(numbers + window),
                pa.array(edges[:-1] - cut[window]),
                pa.array(full[window]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"])
            numbers += len(cuts) - 1
            ids = ids[stop:]
            rest = [(d, int(e - max(b, stop)), int(max(b, stop) - b)) for d, b, e in zip(docs_of, begins, ends, strict=True) if e > stop]
            docs_of = [[d[0], d[1] + gone, left, d[3]] for d, left, gone in rest]

        for batch in slices(batches, size=READ_BYTES):
            fresh, first = known.of(texts_of(batch))
            sizes = np.diff(first).tolist()
            own = texts_of(batch, "doc_id").cast(pa.int64()).to_pylist()
            ids = np.concatenate((ids, fresh))
            docs_of += [[i, 0, n, n] for i, n in zip(own, sizes, strict=True)]
            if len(ids) >= stretch:
                yield from given(False)
        if len(ids):
            yield from given(True)

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)


_KNOWN: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    if path not in _KNOWN:
        _KNOWN[path] = Ids(path)
    return _KNOWN[path]
