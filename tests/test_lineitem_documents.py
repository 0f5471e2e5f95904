"""Documents of line items, and titles found in many of them."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answergrid import fields_as_columns, many_fields
from answergrid.operators import many_titles
from answergrid.plans import QUERIES, inputs


@pytest.fixture
def odd_items(spark, tmp_path):
    rows = [
        (1, 2, 3, 1, 17.0, 1e10, 0.05, float("nan"), 'a"b', "back\\slash", "2024-01-02 03:04:05.678901"),
        (2, None, None, None, None, float("-inf"), 1e-5, -0.0, "line\nend é😀", "", None),
        (2, None, None, None, None, float("-inf"), 1e-5, -0.0, None, None, "0001-01-01 00:00:00"),
    ]
    names = "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate STRING"
    df = spark.createDataFrame(rows, names).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_documents_are_as_json_writes_them(spark, odd_items):
    df = spark.read.parquet(f"{odd_items}/lineitem.parquet")
    for repeats in (1, 2):
        records = [{"question_title": f"Line {c[2:]} {r}", "value_text": F.col(c).cast("string")} for r in range(repeats) for c in df.columns]
        wanted = df.select("l_orderkey", "l_linenumber", inputs.records_json(*records).alias("answers"))
        got = inputs.lineitem_answers(spark, odd_items, repeats)
        assert got.schema.names == wanted.schema.names
        assert sorted(got.collect(), key=str) == sorted(wanted.collect(), key=str)


def test_many_titles_of_odd_items(spark, odd_items):
    got = sorted((tuple(r) for r in QUERIES["many_titles_lineitem"].run(spark, odd_items).collect()), key=str)
    assert [r[2:] for r in got] == [
        ("2", "1.0E10", 'a"b', "", 33),
        ("", "-Infinity", "", "", 15),
        ("", "-Infinity", "line\nend é😀", "", 15),
    ]


def test_values_go_back_once_per_record():
    """A row gives back its records' values and the default, not a value per title."""
    titles = [f"title {i}" for i in range(300)] + ["itle 7"]
    find = many_titles._finder(many_titles.Titles(titles), "none").func
    records = [
        {"texts_0": ["title 7", "title 299 title 7"], "values_0": ["a", "b"]},
        {"texts_1": ["title 1", "title 1 title 7"], "values_1": ["c", "d"]},
        {"texts_0": [], "values_0": []},
    ]
    none = pa.array([None] * 3, pa.struct({"value": pa.binary(), "metadata": pa.binary()}))
    got = find(none, pa.array(map(json.dumps, records), pa.string())).to_pylist()
    assert [sorted(r["own"]) for r in got] == [["a", "b", "none"], ["c", "d", "none"], ["none"]]
    said = [[r["own"][i] for i in r["which"]] for r in got]
    assert [{t: s for t, s in zip(titles, row, strict=True) if s != "none"} for row in said] == [
        {"title 2": "b", "title 7": "a", "title 29": "b", "title 299": "b", "itle 7": "a"},
        {"title 1": "c", "title 7": "d", "itle 7": "d"},
        {},
    ]


def any_value(rng, depth=0):
    kind = rng.random()
    if kind < 0.5 or depth > 2:
        return rng.choice([None, True, False, 0, -7, 300, 70_000, -5_000_000_000, 1.5, 100.0, -2.50, 'a"b\\c\n\x01/é', "Имя", "x" * 80, ""])
    if kind < 0.75:
        return [any_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: any_value(rng, depth + 1) for k in rng.sample(["b", "a", "title", 'é"q'], rng.randint(0, 3))}


def any_record(rng):
    keys = ["question_title", "title", "question", "name", "label", "key", "value_text", "answer", "text", "value", "response", "comment"]
    words = ["Имя", "Full NAME", "ÉTÉ x", "a 100", "STRASSE", "ẞ İ", "Σας", True, 15, "σ"]
    return {k: rng.choice(words) if rng.random() < 0.6 else any_value(rng) for k in rng.sample(keys, rng.randint(0, 6))}


def test_documents_read_in_python_as_by_spark(spark):
    """Values of every kind, rare letters, doubles and escapes, beside plain documents."""
    rng, texts = random.Random(5), ["not json", "", None, "[]", '{"list": []}', "null", "5", '"x"']
    for _ in range(60):
        some = [rng.choice([any_record(rng), any_record(rng), None, "text", [any_record(rng)]]) for _ in range(rng.randint(0, 4))]
        for d in ({"list": some}, some, any_record(rng) | {"list": rng.choice([5, None, some, {}])}, any_record(rng)):
            texts.append(json.dumps(d, ensure_ascii=rng.random() < 0.2))
    for value in ("1e5", "1" * 39, "12345678901234567890.12345678901234567", "-0.0", "0.00000000000000000001", "-12.3400"):
        texts.append(f'{{"name": "n", "name": "full name", "value": {value}}} and more')
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, j STRING")
    plain = df.where(many_titles._is_plain(df, "j")).count()
    assert 50 < plain < len(texts) - 50
    titles = ["name", "имя", "été", "100", "true", "15", "strasse", "ß", "i̇", "σ", "full", "e", "absent", "1.5", '"a":', "null", "["]
    for how in ({}, {"default": None}):
        wanted = fields_as_columns(df, "j", titles, **how).collect()
        got = many_fields(df, "j", titles, **how).collect()
        assert sorted(got, key=lambda r: r["id"]) == sorted(wanted, key=lambda r: r["id"])


def test_no_arrays_go_to_python(spark, odd_items):
    """For the size of a batch Spark goes through all its arrays, for every row."""
    plan = QUERIES["many_titles_lineitem"].run(spark, odd_items)._jdf.queryExecution().executedPlan().toString()
    call = plan[plan.index("ArrowEvalPython") :].split("\n", 1)[0]
    assert ".document, CASE WHEN isnull(" in call and "StructsToJson" in call
