"""Small tables with NULLs, empty and repeated rows and clashing columns, and brute force."""

import io
import itertools
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answergrid.llm import language_id, line_dedup, near_dedup, toxicity, warc_zip
from answergrid.llm.batches import words
from answergrid.llm.chat import format_chats
from answergrid.llm.decontaminate import decontaminate, find_benchmark
from answergrid.llm.language_id import identify, learn
from answergrid.llm.line_dedup import drop_common_lines
from answergrid.llm.mixing import mix_sources
from answergrid.llm.near_dedup import drop_near_duplicates, near_duplicates
from answergrid.llm.perplexity import judge_quality, kneser_ney
from answergrid.llm.secret_scan import RULES, Rule, read_ledger, scan_secrets
from answergrid.sources.shared import new_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, LONG, "en", "a", 9), (2, LONG, "en", "a", 9), (2, LONG, "en", "a", 9), (3, LONG + " end", "en", None, 9),
    (4, None, None, "b", None), (5, "", "en", "b", 0), (None, "Other words of a row without an id here.", "en", "b", 1),
    (6, "eins zwei drei vier fünf sechs sieben acht neun zehn", "de", "c", 2), (7, "!!! ???", "de", "c", 2),
]
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_words_are_those_of_the_pattern():
    texts = ["Ab-c9 É_x", None, "", "\n a b ", "x" * 3000 + " y"]
    hashes, first = words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        found = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert first[i + 1] - first[i] == len(found)
        for w, h in zip(found, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lines(spark, docs):
    rows = [(i, f" Shared\t\n\nown {i}\nshared", 5) for i in range(10)] + [(10, None, 5), (10, "", 5)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_lines INT")
    for bound in (1 << 20, 1):
        got = sorted(tuple(r) for r in drop_common_lines(df, 10, bound).select("doc_id", "text", "n_lines", "n_dropped").collect())
        assert got == sorted([(i, f"\nown {i}", 4, 2) for i in range(10)] + [(10, "", 1, 0)] * 2)
    assert drop_common_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    levels = line_dedup.perfect_hash(keys)
    assert sorted(line_dedup.slots(line_dedup.packed_levels(levels), keys)) == list(range(len(keys)))


def test_lines_in_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(f"line {x}" for x in rng.zipf(1.2, 60) % 300)) for i in range(60)] + [(7, None), (8, "")]
    holders = {}
    for n, (_, t) in enumerate(rows):
        for line in set((t or "").split("\n")) - {""}:
            holders.setdefault(line, set()).add(n)
    wanted = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(x, ())) < 5]
        wanted.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 12)
    for most in (1 << 20, 400):
        got = drop_common_lines(df, 5, most).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_columns_of_any_name_go_through(spark, docs):
    names = ["row", "gone", "odds", "rounds", "own_source", "l", "below", "middle", "above", "more", "key", "kept_id", "kept_key", "_row", "n"]
    df = docs.withColumns({name: F.lit(7) for name in names})
    item = spark.createDataFrame([(1, LONG), (2, "z y")], "item_id LONG, text STRING")
    for out in (drop_common_lines(df, 2, 1), mix_sources(df), find_benchmark(df, item, block_chars=100), judge_quality(df), drop_near_duplicates(df)):
        assert {tuple(r) for r in out.select(*names).collect()} == {(7,) * len(names)}


def test_languages(spark, docs):
    teach = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("the cat and the dog sat here", "en"), ("der hund und die katze sitzen", "de")] * 5)]
    model = learn(spark.createDataFrame(teach, SCHEMA))
    got = {(r["doc_id"], r["text"]): r for r in identify(docs.withColumnRenamed("n_chars", "score"), model).collect()}
    assert got[4, None]["lang_pred"] == got[5, ""]["lang_pred"] == got[7, "!!! ???"]["lang_pred"] == "und"
    asked = spark.createDataFrame([(1, "the dog", None, None, None), (2, "die KATZE", None, None, None)], SCHEMA)
    assert [r["lang_pred"] for r in identify(asked, model).orderBy("doc_id").collect()] == ["en", "de"]
    assert {r["lang_pred"] for r in identify(asked, learn(docs.limit(0))).collect()} <= {"und"}


def test_rare_grams_are_not_owned(spark, monkeypatch):
    teach = [(i, "the cat and the dog sat here", "en") for i in range(9)] + [(9, "the cat xqzv", "en")]
    df = spark.createDataFrame(teach, "doc_id LONG, text STRING, lang STRING")
    asked = spark.createDataFrame([(1, "xqzv xqzv"), (2, "the cat")], "doc_id LONG, text STRING")

    def known():
        return [r["known"] for r in identify(asked, learn(df)).orderBy("doc_id").collect()]

    rare, usual = known()
    assert rare > 0.3 and usual > 0.99
    monkeypatch.setattr(language_id, "LEAST_RATE", 0.01)
    rare, usual = known()
    assert rare < 0.01 and usual > 0.99


def brute_contamination(text, items):
    w = WORD.findall((text or "").lower())
    hit, found = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").lower())
        m = min(10, len(x))
        for i in range(len(x) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == x[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), sorted(f for f in found if f is not None)


@pytest.mark.parametrize("block", [10**9, 150])
def test_contamination(spark, block):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(rng.choice(list("abc"), n))) for i, n in enumerate([12, 3, 1, 0, 15, 25])] + [(None, "z y"), (9, None)]
    rows = [(i, " ".join(rng.choice(list("abcdzy"), n))) for i, n in enumerate([0, 5, 60, 200, 90])] + [(8, None), (8, items[5][1] + " " + items[5][1])]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    for r in find_benchmark(df, bench, block_chars=block).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(r["text"], items)
        assert r["contaminated"] == (r["n_hit"] > 0)
    assert max(r["longest"] for r in find_benchmark(df, bench, block_chars=block).collect()) == 25
    assert decontaminate(df, bench.limit(0)).count() == len(rows)


def test_mixing(spark, docs):
    mixed = mix_sources(docs, {"a": 1.0, None: 1.0}, total=400).collect()
    assert {r["source"] for r in mixed} == {"a", None}
    many = spark.range(4000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'x', 'y') AS source", "'c' AS copy")
    got = mix_sources(many, {"x": 3.0, "y": 1.0}, total=80_000).groupBy("source").count().collect()
    assert {r["source"]: round(r["count"] / 10_000) for r in got} == {"x": 6, "y": 2}
    assert mix_sources(docs.limit(0)).count() == 0


def test_near_copies(spark, docs):
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 5000, 150) for _ in range(6)]
    rows = []
    for b in bases:
        for _ in range(8):
            own = b.copy()
            own[rng.choice(150, rng.integers(0, 5), replace=False)] = rng.integers(0, 5000)
            rows.append((len(rows), " ".join(f"v{x}" for x in own)))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    idf = near_dedup.word_weights(df)
    class_of = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    pairs = list(itertools.combinations(rows, 2))
    near = near_dedup.similarity(pa.array([a[1] for a, _ in pairs]), pa.array([b[1] for _, b in pairs]), idf)
    head = {i: i for i, _ in rows}
    for ((a, _), (b, _)), s in zip(pairs, near, strict=True):
        if s >= 0.8:
            x, y = head[a], head[b]
            head = {k: min(x, y) if v in (x, y) else v for k, v in head.items()}
    assert class_of == head
    kept = drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4, 6, 7]
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rows = [(i, "plain words here" + (" awful slur" if i % 4 == 0 else ""), i) for i in range(400)] + [(None, None, 1), (500, "", 1)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, score INT")
    labels = df.where("doc_id < 400").selectExpr("doc_id", "int(doc_id % 4 = 0) AS label")
    scored = toxicity.score_toxicity(df, toxicity.learn(df, labels)).collect()
    assert {r["doc_id"] for r in scored if r["score"] >= 0.3} == set(range(0, 400, 4))
    assert all(0 <= r["score"] <= 1 for r in scored)
    nothing = toxicity.score_toxicity(df, toxicity.learn(df, labels.limit(0))).collect()
    assert {r["score"] for r in nothing} == {0.0}


def test_few_labels_teach_and_all_words_count(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 4000) + (" awful slur" if i % 7 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for labelled in (28, 300):
        index = toxicity.learn(df, df.where(f"doc_id < {labelled}").selectExpr("doc_id", "int(doc_id % 7 = 0) AS label"))
        assert len(index.terms) == len({w for _, t in rows[:labelled] for w in t.split()})
        row, term, times = toxicity.sparse_rows(pa.array([t for _, t in rows]), index.terms)
        vectors = np.zeros((len(rows), len(index.terms)))
        vectors[row, term] = index.weights(term, times)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        cosines = vectors @ vectors[:labelled].T
        scored = {r["doc_id"]: r for r in toxicity.score_toxicity(df, index).collect()}
        for i, c in enumerate(cosines):
            best = np.lexsort((np.arange(labelled), -np.round(c, 12)))[: toxicity.NEIGHBOURS]
            best = best[c[best] > 0]
            wanted = (c[best] @ (best % 7 == 0) + toxicity.PRIOR * index.base) / (c[best].sum() + toxicity.PRIOR)
            assert np.isclose(scored[i]["score"], wanted)
            assert np.allclose([e["cosine"] for e in scored[i]["evidence"]], c[best[:3]])
            assert i >= labelled or scored[i]["evidence"][0]["doc_id"] == i
    assert min(scored[i]["score"] for i in range(0, 400, 7)) > max(scored[i]["score"] for i in range(400) if i % 7)


def test_toxicity_reads_few_postings(monkeypatch):
    rng = np.random.default_rng(3)
    held = [np.sort(rng.choice(400, size, replace=False)) for size in [400] * 30 + [3] * 600]
    term = np.repeat(np.arange(len(held)), [len(x) for x in held])
    scale = np.repeat([0.01, 5.0], [30, 600])
    triples = np.concatenate(held), term, rng.integers(1, 4, len(term))
    index = toxicity.ExampleIndex(np.arange(630, dtype=np.uint64), scale, list(range(400)), np.arange(400) % 2, triples)
    read, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda begin, end: read.append(int((end - begin).sum())) or ranges(begin, end))
    matrix = np.zeros((400, 630))
    matrix[index.example, np.repeat(np.arange(630), index.held)] = index.weight
    asked = []
    for heavy in [60] * 20 + [3, 1]:
        own = np.concatenate((np.arange(30), np.sort(rng.choice(np.arange(30, 630), heavy, replace=False))))
        weight = index.weights(own, rng.integers(1, 4, len(own)))
        weight /= np.sqrt((weight**2).sum())
        asked.append(int(index.held[own].sum()))
        best, cosine = index.nearest(own, weight)
        wanted = matrix[:, own] @ weight
        assert best.tolist() == np.lexsort((np.arange(400), -np.round(wanted, 12)))[: toxicity.NEIGHBOURS].tolist()
        assert np.allclose(cosine, wanted[best], atol=1e-12)
    assert sum(read) < 0.5 * sum(asked)


def test_secrets_are_scanned_once(spark, docs):
    ledger = new_path(spark, "ledger")
    rows = [(1, "É Password = 'abcdef1' x"), (2, None), (3, "É Password = 'abcdef1' x"), (3, "token: secret: abcdefgh")]
    df = spark.createDataFrame(rows, "path LONG, text STRING")
    got = sorted((r["path"], str({k: [tuple(s) for s in v] for k, v in r["spans"].items()})) for r in scan_secrets(df, ledger).collect())
    assert got == [(1, "{'assign': [(2, 21)]}"), (2, "{}"), (3, "{'assign': [(0, 13)]}"), (3, "{'assign': [(2, 21)]}")]
    assert read_ledger(spark, ledger).count() == 3 * len(RULES)
    scan_secrets(df, ledger).count()
    assert read_ledger(spark, ledger).count() == 3 * len(RULES)
    newer = (Rule("assign", "2", RULES[0].pattern, 2, 6), *RULES[1:])
    scan_secrets(df, ledger, newer).count()
    assert read_ledger(spark, ledger).count() == 3 * len(RULES) + 3


def test_archives(spark):
    rows = [(1, "http://a\n", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (None, "n", ""), (4, "v", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    manifest = warc_zip.write_archives(pages, archive_bytes=3000)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_zip.read_archives(manifest).collect()), key=str)
    assert got == sorted(
        [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "response", None, 0), (None, "revisit", 3, 0), (4, "response", None, 10000)], key=str
    )
    small = {r["record_type"] for r in warc_zip.read_archives(warc_zip.write_archives(pages, least_bytes=10**6)).collect()}
    assert small == {"response"}


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("one", b"first " * 9)
        archive.writestr("two", b"second member")
    assert b"PK\x06\x06" in packed.getvalue()
    file = pa.BufferReader(packed.getvalue())
    found = {n: file.read_at(size, at) for n, (_, at, size) in warc_zip.directory(file).items()}
    assert found == {"one": b"first " * 9, "two": b"second member"}


def test_quality(spark, docs):
    got = {(r["doc_id"], r["n_words"]): r for r in judge_quality(docs.withColumnRenamed("n_chars", "kept")).collect()}
    assert got[4, 0]["base_failed"] and not got[4, 0]["kept"]
    assert got[1, 40]["kept"] and got[1, 40]["n_repeat_words"] == 0
    assert judge_quality(docs.limit(0)).count() == 0


def test_bands_reject_text_unlike_its_language(spark):
    rng = np.random.default_rng(4)
    known = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(300)]
    odds = 1 / np.arange(1, 301)

    def text(n, strange):
        drawn = rng.choice(known, n, p=odds / odds.sum())
        return " ".join("".join(rng.permutation(list(w))) if rng.random() < strange else w for w in drawn)

    rows = [(i, text(int(rng.integers(60, 600)), 0), "en") for i in range(400)] + [(i, text(300, 0.08), "en") for i in range(400, 410)]
    # Copies of one text do not narrow the band.
    rows += [(i, rows[0][1], "en") for i in range(410, 420)]
    got = {r["doc_id"]: r["kept"] for r in judge_quality(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")).collect()}
    assert sum(got[i] for i in range(400)) >= 396
    assert not any(got[i] for i in range(400, 410))


def brute_kneser_ney(counts, level_discounts):
    """All probabilities by definition: counts maps 5-grams (tuples) of one language."""
    levels = {5: counts}
    for m in range(4, 0, -1):
        levels[m] = {}
        for g in levels[m + 1]:
            levels[m][g[1:]] = levels[m].get(g[1:], 0) + 1

    def prob(m, g):
        if m == 0:
            return 2.0**-12
        d = level_discounts(levels[m])
        near = {x: n for x, n in levels[m].items() if x[:-1] == g[:-1]}
        if not near:
            return prob(m - 1, g[1:])
        off = sum(d[min(n, 3)] for n in near.values())
        n = levels[m].get(g, 0)
        return (n - d[min(n, 3)] + off * prob(m - 1, g[1:])) / sum(near.values())

    def left_out(m, g):
        if m == 0:
            return 2.0**-12
        d = level_discounts(levels[m])
        near = {x: n - (x == g) for x, n in levels[m].items() if x[:-1] == g[:-1]}
        lower = left_out(m - 1, g[1:]) if levels[m][g] == 1 else prob(m - 1, g[1:])
        if not sum(near.values()):
            return lower
        off = sum(d[min(n, 3)] for n in near.values())
        return (near[g] - d[min(near[g], 3)] + off * lower) / sum(near.values())

    return {g: (prob(5, g), left_out(5, g)) for g in counts}, prob


def brute_discounts(level):
    n1, n2, n3, n4 = (sum(n == i for n in level.values()) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    plain = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [0, *[min(max(x, 0.05), i + 0.95) for i, x in enumerate(plain)]]


def packed(gram):
    return sum(s << (12 * (4 - i)) for i, s in enumerate(gram))


def test_model_is_kneser_ney(spark):
    rng = np.random.default_rng(2)
    drawn = [tuple(g) for g in rng.choice([1, 2, 4095], (300, 5), p=[0.6, 0.3, 0.1]).tolist()]
    counts = {g: drawn.count(g) for g in drawn}
    table = spark.createDataFrame([(lang, packed(g), n) for lang in ("a", "b") for g, n in counts.items()], "lang string, gram long, n long")
    wanted, prob = brute_kneser_ney(counts, brute_discounts)
    got = {(r["lang"], r["gram"]): (r["prob"], r["left_out"]) for r in kneser_ney(table).collect()}
    assert len(got) == 2 * len(counts)
    for g, w in wanted.items():
        assert np.allclose(got["a", packed(g)], w) and np.allclose(got["b", packed(g)], w)
    assert np.isclose(sum(prob(5, (1, 2, 1, 1, s)) for s in (1, 2, 4095)) + 4093 * prob(5, (1, 2, 1, 1, 7)), 1)


def test_rounds_of_a_model_add_up(spark, docs):
    from answergrid.llm.perplexity import score

    def scores(df):
        return sorted((str(r["doc_id"]), str(r["text"]), round(r["log_perplexity"], 5)) for r in df.collect())

    whole = scores(score(docs))
    assert scores(score(docs, round_grams=1)) == whole
    assert len(whole) == len(ROWS) and max(s for _, _, s in whole) > 1


def test_chats(spark):
    rows = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, None, None, None), (4, 5000, "u", ""), (None, 1, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    got = sorted(((r["conv_id"], r["part"], r["n_turns"], r["copies"], r["chat"]) for r in format_chats(df).collect()), key=str)
    turn = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert got == sorted(
        [(2, 0, 2, 2, turn("u", "hi") + turn("a", "yo")), (4, 0, 2, 1, turn("", "")), (4, 4, 2, 1, turn("u", "")), (None, 0, 1, 1, turn("u", "x"))], key=str
    )
    assert format_chats(df.limit(0)).count() == 0
