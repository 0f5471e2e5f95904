"""Field extraction against an independent model, on random documents."""

import json
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from answergrid import field_names, fields_as_columns, register_sql_functions

TITLES = ["Age", "age group", "a_e", "100%", "Name", "e", "Ваше имя", "x" * 40, "%", "no such"]
# Keys that decide results.
MATCH = ["question_title", "title", "question", "name"]
VALUES = ["value_text", "answer", "text", "value", "response"]
ROOT_VALUES = ["value_text", "value", "text", "answer", "response", "description", "comment"]
ALL_KEYS = list(dict.fromkeys([*MATCH, "label", "key", *VALUES, *ROOT_VALUES, "list", "other"]))
TEXTS = ["Age", "AGE GROUP", "company name", "ake", "100 %", "", "ВАШЕ ИМЯ", "x" * 30, "e", "zz"]


def text_of(value):
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), sort_keys=True)


def like(text, title, length):
    parts = {"%": ".*", "_": "."}
    pattern = "".join(parts.get(c, re.escape(c)) for c in title[:length].lower())
    return re.fullmatch(f".*{pattern}.*", text.lower(), re.DOTALL) is not None


def first_value(items, title, length, match_keys, value_keys):
    for item in items:
        if not isinstance(item, dict):
            continue
        texts = (text_of(item.get(k)) for k in match_keys)
        if any(t is not None and like(t, title, length) for t in texts):
            found = (text_of(item.get(k)) for k in value_keys)
            return next((v for v in found if v is not None), "")
    return None


def model(doc, title, length=None):
    listed = doc.get("list") if isinstance(doc, dict) else None
    found = first_value(listed if isinstance(listed, list) else [], title, length, MATCH, VALUES)
    if found is None:
        root = doc if isinstance(doc, list) else [doc]
        found = first_value(root, title, length, [*MATCH, "label", "key"], ROOT_VALUES)
    return "" if found is None else found


def check(spark, docs, length=None):
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id INT, j STRING")
    got = {r["id"]: r for r in fields_as_columns(df, "j", TITLES, pattern_length=length).collect()}
    for i, doc in enumerate(docs):
        for name, title in zip(field_names(TITLES), TITLES):
            assert got[i][name] == model(doc, title, length), (doc, title)


def random_document(r):
    def scalar():
        return r.choice([None, True, 7, -3, r.choice(TEXTS), r.choice(TEXTS), {"b": 1, "a": ["x"]}])

    def element():
        if r.random() < 0.15:
            return r.choice([None, 5, "Age", ["Age", "v"], []])
        return {k: scalar() for k in r.sample(ALL_KEYS, r.randint(0, 4)) if k != "list"}

    def elements():
        return [element() for _ in range(r.randint(0, 4))]

    shape = r.random()
    if shape < 0.4:
        return {**element_or_empty(element), "list": elements()}
    if shape < 0.7:
        return elements()
    if shape < 0.9:
        return element_or_empty(element)
    return r.choice([None, "Age", 3, {"list": "Age", "title": "Age", "value": "v"}, {"list": {}}])


def element_or_empty(element):
    made = element()
    return made if isinstance(made, dict) else {}


def test_many_random_documents(spark):
    r = random.Random(7)
    docs = [random_document(r) for _ in range(20_000)]
    check(spark, docs)
    check(spark, docs, 30)


def test_sql_function_on_random_documents(spark):
    r = random.Random(11)
    docs = [random_document(r) for _ in range(3_000)]
    rows = [(i, json.dumps(d, ensure_ascii=False), r.choice(TITLES)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id INT, j STRING, t STRING")
    for length in (30, None):
        register_sql_functions(spark, length)
        got = spark.sql(
            "SELECT id, json_field(j, t) AS one, json_fields(j, array('Age', t)) AS both FROM {df}", df=df
        )
        for row, (i, _, title) in zip(got.orderBy("id").collect(), rows, strict=True):
            expected = model(docs[i], title, length)
            assert row["one"] == expected, (docs[i], title)
            assert row["both"] == [model(docs[i], "Age", length), expected], (docs[i], title)


scalars = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.sampled_from(TEXTS))
records = st.dictionaries(st.sampled_from(ALL_KEYS), scalars, max_size=4)
elements = st.lists(st.one_of(records, scalars, st.lists(scalars, max_size=2)), max_size=4)
documents = st.one_of(
    st.builds(lambda d, items: {**d, "list": items}, records, elements), elements, records, scalars
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(documents, min_size=30, max_size=60))
def test_generated_documents(spark, docs):
    check(spark, docs)
