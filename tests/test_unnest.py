"""Documents as rows and wide tables, and their profiles."""

import pytest

from answergrid import (
    candidate_titles,
    json_schema,
    profile_json,
    unnest_entries,
    unnest_pivot,
    unnest_positional,
    unnest_rows,
)

ARRAY = '[{"question":"A","answer":"1"},{"question":"B","answer":2},{"question":"A","answer":"3"}]'


def frame(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), "id INT, j STRING")


def test_rows(spark):
    df = frame(spark, ARRAY, "[1,null,\"x\",[2]]", '{"a":1}', None, "[]")
    rows = [tuple(r) for r in unnest_rows(df, "j").collect()]
    assert rows[0] == (0, 0, '{"answer":"1","question":"A"}')
    assert rows[3:] == [(1, 0, "1"), (1, 1, None), (1, 2, "x"), (1, 3, "[2]")]
    rows = [tuple(r) for r in unnest_rows(df, "j", keys=["answer"]).collect()]
    assert rows == [(0, 0, "1"), (0, 1, "2"), (0, 2, "3"), *[(1, i, None) for i in range(4)]]


def test_entries(spark):
    df = frame(spark, '{"b":{"x":1},"a":"t"}', "[1]", None)
    kept = unnest_rows(df.selectExpr("id", "'old' AS VALUE", "'[7]' AS j"), "j")
    assert (kept.columns, tuple(kept.first())) == (
        ["id", "VALUE", "pos", "value_1"],
        (0, "old", 0, "7"),
    )
    rows = {tuple(r) for r in unnest_entries(df, "j").collect()}
    assert rows == {(0, "a", "t"), (0, "b", '{"x":1}')}


def test_positional(spark):
    df = frame(spark, ARRAY, '{"question":"only","answer":"one"}', '{"list":' + ARRAY[:-1] + "]}", None)
    wide = unnest_positional(df, "j", "question", "answer")
    assert wide.columns[2:] == [f"j_{k}_{i}" for i in (1, 2, 3) for k in ("question", "answer")]
    rows = [tuple(r)[2:] for r in wide.collect()]
    assert rows[0] == rows[2] == ("A", "1", "B", "2", "A", "3")
    assert rows[1] == ("only", "one", None, None, None, None)
    assert rows[3] == (None,) * 6
    narrow = unnest_positional(df, "j", "question", "answer", 1, prefix="p")
    assert narrow.columns == ["id", "j", "p_question_1", "p_answer_1"]
    assert unnest_positional(frame(spark, None), "j", "question", "answer").columns == ["id", "j"]


def test_pivot(spark):
    df = frame(spark, ARRAY, '{"list":[{"question":"C d","answer":"9"},{"answer":"no name"}]}', "7")
    wide = unnest_pivot(df, "j", "question", "answer").drop("j")
    assert wide.columns == ["id", "a", "b", "c_d"]
    assert [tuple(r) for r in wide.collect()] == [
        (0, "1", "2", None), (1, None, None, "9"), (2, None, None, None),
    ]
    named = unnest_pivot(df, "j", "question", "answer", ["b", "B"]).drop("j")
    assert named.columns == ["id", "b", "b_1"]
    assert tuple(named.first()) == (0, None, "2")


def test_keys_that_differ_in_case(spark):
    df = frame(spark, '[{"K":"a","k":"1"},{"K":"b","k":"2"}]')
    assert tuple(unnest_pivot(df, "j", "K", "k").drop("j").first()) == (0, "1", "2")


def test_too_many_names_is_an_error(spark):
    with pytest.raises(ValueError):
        unnest_pivot(frame(spark, ARRAY), "j", "question", "answer", most_columns=1)
    with pytest.raises(ValueError):
        unnest_positional(frame(spark, ARRAY), "j", "question", "answer", most_columns=1)


def test_profile(spark):
    df = frame(spark, '{"a":1,"b":"t"}', '{"a":"s","b":null}', '[{"q":true},5]', "nonsense", None)
    got = {tuple(r) for r in profile_json(df, "j").collect()}
    assert got == {
        ("$", "object", 2, None), ("$", "array", 1, None),
        ("$.a", "number", 1, "1"), ("$.a", "string", 1, "s"),
        ("$.b", "string", 1, "t"), ("$.b", "null", 1, None),
        ("$[*]", "object", 1, None), ("$[*]", "number", 1, "5"),
        ("$[*].q", "boolean", 1, "true"),
    }
    nested = profile_json(frame(spark, '{"list":[{"t":"x"}]}'), "j", "$.list")
    assert {tuple(r) for r in nested.collect()} == {
        ("$.list", "array", 1, None), ("$.list[*]", "object", 1, None),
        ("$.list[*].t", "string", 1, "x"),
    }
    long = frame(spark, '{"t":"' + "x" * 100 + '"}')
    assert profile_json(long, "j").where("path = '$.t'").first()["sample"] == "x" * 100
    assert profile_json(long, "j", sample_length=99).where("path = '$.t'").first()["sample"] is None


def test_profile_of_a_typed_column(spark):
    df = spark.sql("SELECT named_struct('d', DATE '2024-01-02', 'f', 1.5F) AS s")
    got = {r["path"]: r["kind"] for r in profile_json(df, "s").collect()}
    assert got == {"$": "object", "$.d": "date", "$.f": "number"}


def test_schema_of_a_column(spark):
    df = frame(spark, '{"a":1}', '{"b":"t"}')
    assert json_schema(df, "j").first()[0] == "OBJECT<a: BIGINT, b: STRING>"


def test_candidate_titles(spark):
    df = frame(spark, '[{"t":"Ваш дом","u":"short"},{"t":"Как?","v":12345678901}]', '[{"t":"Как?"}]',
               '[{"t":"exactly 10"},{"t":"eleven char"}]')
    got = {tuple(r) for r in candidate_titles(df, "j").collect()}
    assert got == {("$[*].t", "Ваш дом", 1), ("$[*].t", "Как?", 2), ("$[*].t", "eleven char", 1)}
