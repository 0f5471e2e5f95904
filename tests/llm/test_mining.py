"""Packing, spelling variants and phrases against brute force, and their edge cases."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from answergrid.llm import packing, phrases, spelling
from answergrid.llm.mining_queries import op11_packing
from answergrid.llm.packing import best_cuts, pack
from answergrid.llm.phrases import mine_phrases
from answergrid.llm.spelling import near_words, one_edit, spelling_variants

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
TOKENIZER.encode_special_tokens = True


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END]


def check_pieces(rows, pieces, sequence):
    """Whole documents, gapless sequences, and the padding of each sequence's length."""
    wanted = Counter((i, tuple(ids_of(t))) for i, t in rows)
    in_sequences = defaultdict(list)
    whole = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        in_sequences[p["sequence_id"]].append(p)
        parts = whole[p["doc_id"]]
        if p["start"] == 0:
            parts.append([])
        assert len(parts[-1]) == p["start"]
        parts[-1].extend(ids)
    assert Counter((i, tuple(x)) for i, parts in whole.items() for x in parts) == wanted
    padding = 0
    for parts in in_sequences.values():
        assert [p["offset"] for p in parts] == list(itertools.accumulate([0, *[p["length"] for p in parts[:-1]]]))
        length = sum(p["length"] for p in parts)
        assert length <= sequence
        assert {p["sequence_length"] for p in parts} == {length if length & (length - 1) == 0 else sequence}
        padding += parts[0]["sequence_length"] - length
    return padding


@pytest.mark.parametrize("stretch", [packing.STRETCH, 300])
def test_packing_is_a_round_trip(spark, stretch):
    rng = np.random.default_rng(1)
    words = ["The", "cat!", "sat.", "É", "naïve", "don't", "x\x0by", "日本", "<|endoftext|>", "12.5", "Σας", "á"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 90)))) for i in range(40)]
    rows += [(None, "no id here."), (77, None), (77, ""), (88, " \n\t "), (99, "word " * 4000), (99, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS ids", "2 AS sequence_id", "3 AS start").coalesce(2)
    got = pack(df, sequence=64, stretch=stretch).collect()
    check_pieces(rows, got, 64)
    assert {p["doc_tokens"] for p in got if p["doc_id"] == 99} == {len(ids_of(rows[-2][1])), len(ids_of(rows[-1][1]))}
    assert pack(df.limit(0)).count() == 0


def test_packed_documents_have_little_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs).collect()
    padding = check_pieces([tuple(r) for r in docs.collect()], pieces, 2048)
    assert padding < 0.005 * sum(p["length"] for p in pieces)
    digests = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in op11_packing(spark, sf_dir).collect()}
    assert digests == {(p["sequence_id"], p["offset"]): zlib.crc32(p["ids"]) for p in pieces}


def test_cuts_cost_the_least():
    rng = np.random.default_rng(2)
    for sequence in (8, 10, 16):
        for _ in range(40):
            at = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 7, 30)))))
            fee = rng.integers(0, 6, len(at))
            fee[[0, -1]] = 0
            best = {0: 0}
            for j, here in enumerate(at[1:].tolist(), 1):
                sizes = [(here - at[i], best[at[i]]) for i in range(j) if here - at[i] <= sequence]
                best[here] = int(fee[j] + min(c + (0 if n & (n - 1) == 0 else sequence - n) for n, c in sizes))
            cuts = best_cuts(at, fee, sequence)
            fees = dict(zip(at.tolist(), fee.tolist(), strict=True))
            sizes = np.diff(cuts)
            assert sizes.max() <= sequence
            assert sum(0 if n & (n - 1) == 0 else sequence - n for n in sizes.tolist()) + sum(fees[c] for c in cuts) == best[int(at[-1])]


def brute_spelling(rows, altered=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % altered == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            holes[w[:i] + "-" + w[i:]].add(w)
            if i < len(w):
                holes[w[:i] + "-" + w[i + 1 :]].add(w)
    near = {w: set() for w in counts}
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    out = {}
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def spelled(df, **how):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(df, **how).collect()}


def test_spelling_variants(spark):
    rng = np.random.default_rng(3)
    words = ["straße", "straßen", "strassen", "Kitten", "kittens", "kitteñs", "mittens", "×÷éèêë", "aaaaaa", "aaaaaaa", "abcdefghij" * 8, "abcdefghij" * 7 + "abcdefghi"]
    odds = 1 / np.arange(1, len(words) + 1) ** 1.6
    rows = [(i, " ".join(rng.choice(words, 60, p=odds / odds.sum())) + " “kitten” Ωkitten1kitten") for i in range(60)]
    rows += [(None, "kitten Kitten"), (3, None), (3, ""), rows[0], (4, "kitten " * 5000)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS word", "2 AS n", "3 AS node")
    for altered in (199, 7):
        assert spelled(df, altered=altered) == brute_spelling(rows, altered)
    assert spelled(df.limit(0)) == {}
    with pytest.raises(ValueError):
        spelling_variants(df, least_letters=5)


def test_forms_lead_to_roots(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(None, f"{w} " * 5 ** (i + 1)) for i, w in enumerate(chain)]
    got = spelled(spark.createDataFrame(rows, "doc_id LONG, text STRING"), altered=10**9)
    assert {w: r[4] for w, r in got.items()} == dict.fromkeys(chain, "abbbbb")
    assert got["aaaaaa"][2:4] == ("aaaaab", 25) and got["abbbbb"][2] is None


def test_large_nodes_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(6, 10))) for _ in range(1500)})
    df = spark.createDataFrame([(w, int(n)) for w, n in zip(words, rng.integers(5, 90, len(words)), strict=True)], "word string, n long")
    counts = {r["word"]: r["n"] for r in df.collect()}
    wanted = {}
    for w in words:
        near = [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-counts[x], x))
            wanted[w] = (len(near), best, counts[best])
    for sizes in ((1 << 14, 1 << 16, 6), (40, 100, 3), (200, 50, 1)):
        assert {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in near_words(df, *sizes).collect()} == wanted


def test_one_edit_against_all_edits():
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("ab", repeat=n)]
    for a in words:
        edits = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"} | {a[:i] + a[i + 1 :] for i in range(len(a))}
        edits |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"}
        assert {b for b in words if one_edit(a, b)} == (edits - {a}) & set(words)
    long = "x" * 100
    pairs = [(long, long + "y"), (long, "y" + long), (long, long[:50] + "y" + long[51:]), (long, long), (long, long + "yy")]
    left, right = (spelling.Letters([p[i] for p in pairs]) for i in (0, 1))
    assert left.near(np.arange(5), right, np.arange(5)).tolist() == [True, True, True, False, False]


def test_latin_words_go_to_the_model_directly(monkeypatch):
    asked, encoded = [], packing.Ids._encoded
    monkeypatch.setattr(packing.Ids, "_encoded", lambda self, parts: asked.extend(parts) or encoded(self, parts))
    known = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    plain = ["Été née, ÿß Øre!", "BEGELICH!! haedon$$$ foo' (,***", None, "", "Éé." + " ñandú***" * 3 + " x_y`"]
    odd = ["E\u0301te\u0301 H\u0331a h\u0331A x\u0301***", "don't DON'T's 'll it's!'", "ΣΑΣ. İ K ﬁ日本", "<|endoftext|>,", "a\x1cb\x85c\xa0d 1²a ×÷", "naïve\u200d."]
    for texts in (plain, odd):
        ids, first = known.of(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(first)] == [ids_of(t) for t in texts]
        if texts is plain:
            assert not [x for x in asked if x[0] in packing.LATIN and x != "x_y`"]
    assert known.of(pa.array([], pa.string()))[0].tolist() == []


def brute_phrases(rows, least, most):
    found = {}
    for text, lang in rows:
        counts = found.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            counts.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        gone = {p[i : i + k] for p, c in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if c >= f[p[i : i + k]]}
        scored = []
        for p in candidates.keys() - gone:
            score, _, left, right = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("most", "batch", "most_keys"), [(1000, 1 << 25, 1 << 21), (3, 500, 200)])
def test_phrases(spark, most, batch, most_keys):
    rng = np.random.default_rng(5)
    words = np.array(["der", "und", "New", "york", "é", "x y", "öl", "zz", "Q", "r-s"])
    rows = []
    for i in range(60):
        odds = 1 / np.arange(1, 11) ** rng.uniform(0.5, 1.5)
        said = "".join(w + rng.choice([" ", "\t", ", ", ".\n", "\x0b"], p=[0.8, 0.05, 0.05, 0.05, 0.05]) for w in rng.choice(words, 50, p=odds / odds.sum()))
        rows.append((said + " rare pair of words " * (i % 3), [None, "en", "de", "und"][i % 4]))
    rows += [(None, "en"), ("", "de"), (None, None), rows[3], ("one text", "xx"), ("a b " * 3000, "aa")]
    df = spark.createDataFrame(rows, "text STRING, lang STRING").selectExpr("*", "1 AS word", "2 AS n", "3 AS key", "4 AS tokens")
    got = sorted(tuple(r) for r in mine_phrases(df, least=6, most=most, batch=batch, most_keys=most_keys).collect())
    assert got == brute_phrases(rows, 6, most)
    assert len(got) >= 4 * min(most, 3)


def test_no_phrases(spark):
    df = spark.createDataFrame([("a b c", "en")], "text STRING, lang STRING")
    assert mine_phrases(df).count() == 0
    assert mine_phrases(df.limit(0), least=1).count() == 0
    alone = spark.createDataFrame([("a. b, a; b!", "en")] * 3, "text STRING, lang STRING")
    assert mine_phrases(alone, least=2).count() == 0


def test_phrase_passes_get_few_bytes_at_once(spark, monkeypatch):
    tokens, teller = phrases.tokens, phrases._teller

    def small(batches):
        for batch in batches:
            assert batch.nbytes <= 2 * phrases.BYTES_AT_ONCE, batch.nbytes
            yield batch

    monkeypatch.setattr(phrases, "tokens", lambda batches: tokens(small(batches)))
    monkeypatch.setattr(phrases, "_teller", lambda asked: lambda batches: teller(asked)(small(batches)))
    df = spark.range(4000, numPartitions=1).selectExpr("repeat(concat('deep sea ', id % 7, ' . '), 200) AS text", "'en' AS lang")
    assert {r["phrase"] for r in mine_phrases(df).collect()} == {"deep sea", *(f"deep sea {i}" for i in range(7))}
