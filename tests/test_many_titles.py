"""Many titles at once, SQL table functions, profiles of any depth and names that clash."""

import json
import random

import pytest
from pyspark.sql import functions as F

from answergrid import (
    fields_as_columns,
    many_fields,
    profile_all_paths,
    register_field_table,
    unnest_entries,
    unnest_pivot,
    unnest_positional,
    unnest_rows,
)
from answergrid.functions.names import free_names
from answergrid.plans import QUERIES  # noqa: F401
from answergrid.plans.registry import query


def record(rng):
    words = ["Name", "full name", "E-MAIL", "Straße", "ÉTÉ", "100%", "a_b", "x\\y", "phone", ""]
    keys = ["question_title", "title", "question", "name", "label", "key", "value_text", "answer", "text", "value", "response", "comment"]
    return {k: rng.choice([None, 3, " ".join(rng.sample(words, 2))]) for k in rng.sample(keys, 4)}


def documents_frame(spark):
    rng = random.Random(1)
    shapes = []
    for _ in range(150):
        records = [rng.choice([record(rng), record(rng), None, "text"]) for _ in range(rng.randint(0, 5))]
        shapes += [{"list": records}, records, record(rng) | {"list": 5}, record(rng)]
    texts = [json.dumps(s, ensure_ascii=False) for s in shapes] + ["not json", "", None, "[]", '{"list": []}', "null"]
    return spark.createDataFrame(list(enumerate(texts)), "id INT, j STRING")


def test_all_titles_at_once(spark):
    df = documents_frame(spark)
    titles = ["name", "NAME", "mail", "straße", "été", "100%", "a_b", "x\\y", "", "pho%e", "absent", "full name e-mail", "n", "ame"]
    for how in ({}, {"pattern_length": 3}, {"default": None}):
        wanted = fields_as_columns(df, "j", titles, **how)
        got = many_fields(df, "j", titles, **how)
        assert got.columns == wanted.columns
        assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(wanted.collect(), key=lambda r: r["id"])
    assert many_fields(df, "j", []).columns == df.columns
    assert many_fields(df.limit(0), "j", ["a"]).count() == 0


def test_a_filter_does_not_search_again(spark):
    plan = many_fields(documents_frame(spark), "j", ["name", "mail"]).where("mail <> ''")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("parseJson(") == 1


def test_titles_as_a_sql_table(spark):
    df = documents_frame(spark)
    titles = ["name", "it's", "E-mail", "x\\y"]
    names = register_field_table(spark, "some_fields", titles)
    wanted = fields_as_columns(df, "j", titles)
    listed = ", ".join(f"f.`{n}`" for n in names)
    got = spark.sql(f"SELECT id, j, {listed} FROM {{df}} AS d, LATERAL some_fields(d.j) AS f WHERE f.name <> '' OR f.`{names[2]}` = ''", df=df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1 and "Join" not in plan
    kept = wanted.where(f"name <> '' OR `{names[2]}` = ''")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, kept.collect()), key=lambda r: r[0])


def brute_paths(value, path, out):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(value)]
    out.setdefault((path, kind), []).append(value)
    if isinstance(value, dict):
        for k, v in value.items():
            brute_paths(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for v in value:
            brute_paths(v, f"{path}[*]", out)


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, True, False, rng.randint(-5, 99), rng.random(), "a", "zz", "", "é"])
    if rng.random() < 0.5:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: nested(rng, depth - 1) for k in rng.sample("abcd", rng.randint(0, 3))}


@pytest.mark.parametrize("start", [1, 4])
def test_profile_of_any_depth(spark, start):
    rng = random.Random(start)
    docs = [nested(rng, 7) for _ in range(80)]
    deep = "x"
    for i in range(11):
        deep = [deep] if i % 2 else {"k": deep}
    docs.append(deep)
    out = {}
    for d in docs:
        brute_paths(d, "$", out)
    texts = [json.dumps(d) for d in docs] + [None, "not json"]
    df = spark.createDataFrame([(t,) for t in texts], "path STRING")
    got = {(r["path"], r["kind"]): tuple(r)[2:] for r in profile_all_paths(df, "path", depth=start).collect()}
    wanted = {}
    for (path, kind), values in out.items():
        said = [str(v).lower() if kind == "boolean" else v for v in values] if kind in ("string", "boolean") else []
        numbers = [float(v) for v in values] if kind == "number" else []
        said = sorted(said, key=lambda t: t.encode())
        wanted[path, kind] = (len(values), said[0] if said else None, said[-1] if said else None, min(numbers, default=None), max(numbers, default=None))
    assert got == wanted
    assert profile_all_paths(df.limit(0), "path").count() == 0


@pytest.mark.parametrize("taken", ["prepared", "document", "document_0", "found", "item", "items", "names", "values", "pos", "value", "key", "Prepared"])
def test_helper_columns_clash_with_none(spark, taken):
    df = spark.createDataFrame([('{"list":[{"name":"N","value":"v"}]}', 7)], f"j STRING, `{taken}` INT")
    for wide in (
        fields_as_columns(df, "j", ["n"]),
        many_fields(df, "j", ["n"]),
        unnest_rows(df, "j", "$.list"),
        unnest_entries(df, "j"),
        unnest_pivot(df, "j", "name", "value"),
        unnest_positional(df, "j", "name", "value"),
    ):
        assert wide.where(F.col(f"`{taken}`") == 7).count() == 1
        assert len({c.lower() for c in wide.columns}) == len(wide.columns)


def test_free_names():
    assert free_names(["a", "B"], "a", "b", "c", "c") == ["a_", "b_", "c", "c_"]


def test_a_query_name_is_given_once():
    def export_texts_then_read(spark, sf_dir):
        return None

    with pytest.raises(ValueError):
        query("SELECT 1")(export_texts_then_read)
