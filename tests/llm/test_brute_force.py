"""Whole results of the operators without SQL, by their definitions and with no code of theirs."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from answergrid.llm.language_id import identify, learn
from answergrid.llm.perplexity import judge_quality

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def quality_columns(text):
    text = text or ""
    words = re.findall(f"[^{SPACES}]+", text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{SPACES}]", line):
            repeated_lines += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(covered), failed


def test_rules_of_quality(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", "a b c d", "x\n\nx\n x\nx", "w " * 50, "é#|" * 3, "\x0b\x0c one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").selectExpr("*", "'en' AS lang")
    got = {r["doc_id"]: r for r in judge_quality(df).collect()}
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in columns) == quality_columns(text), text
        assert not (got[i]["base_failed"] and got[i]["kept"])


def letter_grams(text):
    """Four letters in lower case; runs of anything else are a blank, and so are both ends."""
    kept = "".join(c.lower() if c.isalpha() else " " for c in text or "")
    kept = re.sub(" +", " ", f" {kept} ")
    return [kept[i : i + 4] for i in range(len(kept) - 3)] if kept != " " else []


def test_languages_against_exact_sets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["doc_id"] % 3:
            counts[r["lang"]].update(letter_grams(r["text"]))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rates = defaultdict(dict)
    for lang, c in counts.items():
        for gram, n in c.items():
            if n / totals[lang] >= 1e-6:
                rates[gram][lang] = n / totals[lang]
    owners = {g: {x for x, r in own.items() if r >= 0.1 * max(own.values())} for g, own in rates.items()}
    docs = spark.createDataFrame(rows)
    found = {r["doc_id"]: r for r in identify(docs, learn(docs.where("doc_id % 3 <> 0"))).collect()}
    names = sorted(totals)
    for r in rows:
        grams = letter_grams(r["text"])
        share = [sum(lang in owners.get(g, ()) for g in grams) / max(len(grams), 1) for lang in names]
        got = found[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got["lang_pred"] == "und"
        else:
            # The Bloom filters and their correction may be off by a little.
            assert share[names.index(got["lang_pred"])] >= max(share) - 0.02
            assert abs(got["known"] - max(share)) < 0.02


@pytest.fixture(scope="module")
def stages(spark):
    """Documents of which each stage has something to do, and what each makes of them."""
    clean = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 600").limit(40)
    benchmark = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(3).collect()]
    base = [r.asDict() for r in clean.collect()]
    rows = [dict(r, doc_id=i, text=r["text"] + f"\nShared footer of all pages.\nown line {i}") for i, r in enumerate(base)]
    rows.append(dict(rows[0], doc_id=100))  # a copy
    rows.append(dict(rows[1], doc_id=101, text=rows[1]["text"] + " more"))  # a near copy
    rows.append(dict(rows[2], doc_id=102, text=rows[3]["text"][:300] + " " + benchmark[0] + " " + rows[4]["text"][:300][::-1]))
    rows.append(dict(rows[2], doc_id=103, text="12345 67890 !!! 555"))
    rows.append(dict(rows[2], doc_id=104, text=None))
    docs = spark.createDataFrame(rows, clean.schema)
    made = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        made.append((name, before.collect(), docs.collect()))
        docs = spark.createDataFrame(made[-1][2], docs.schema)
    return {name: (before, after) for name, before, after in made}, clean.columns


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_pipeline_stages(stages):
    by_name, columns = stages
    assert list(by_name) == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    before, after = by_name["language_id"]
    assert ids(before) - ids(after) == {103, 104}
    before, after = by_name["line_dedup"]
    assert ids(before) == ids(after)
    assert all("Shared footer" not in r["text"] for r in after)
    assert all(f"own line {r['doc_id']}" in r["text"] for r in after if r["doc_id"] < 100)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = by_name["near_dedup"]
    assert {100, 101} <= ids(before) - ids(after)
    assert {0, 1} <= ids(after)
    before, after = by_name["decontamination"]
    assert 102 in ids(before) - ids(after)
    before, after = by_name["mixing"]
    assert ids(after) <= ids(before)
    assert all(list(r.asDict())[: len(columns)] == columns for name in list(by_name)[:-1] for r in by_name[name][1][:1])
