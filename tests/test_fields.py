"""Field extraction on documents with known answers."""

import pytest
from pyspark.sql import functions as F

from answergrid import fields_as_columns, field_names, safe_name, unnest_pivot
from answergrid.functions import strategies as S

LIST = (
    '{"list":[{"title":"Garden plot","answer":"Row 12"},{"question":"Contact (e-mail)","text":"plots@example.org"},'
    '{"name":"Hours watered","response":2.5}]}'
)
ARRAY = '[{"label":"Crops","description":"leek; kale"},{"key":"Soil","comment":"clay"}]'
MIXED = '[{"name":"Harvest","text":"late"},{"question":"Yield in kg","value":31}]'
QUOTED = '{"list":[{"title":"Field\'s \\"Name\\"","value":"q"},{"title":"a\\\\b","value":"s"}]}'
LONG = "An unusually long question title, number one"

CASES = [
    (LIST, "Garden plot", "Row 12"),
    (LIST, "E-MAIL", "plots@example.org"),
    (LIST, "Hours watered", "2.5"),
    (LIST, "Compost", ""),
    (ARRAY, "Crops", "leek; kale"),
    (ARRAY, "Soil", "clay"),
    (MIXED, "Harvest", "late"),
    (MIXED, "yield", "31"),
    ('{"label":"Fence","description":"2 m"}', "Fence", "2 m"),
    ('{"list":[{"question_title":"Notes"}],"title":"Notes","value":"root"}', "Notes", ""),
    ('{"list":[{"title":"Age","value_text":null,"answer":"41"}]}', "Age", "41"),
    ('{"list":[{"title":"Age","value_text":"","answer":"41"}]}', "Age", ""),
    ('{"list":[{"title":"Company Name","value":"Acme"},{"title":"Name","value":"Ann"}]}', "Name", "Acme"),
    ('[["Field Name","Field Value"]]', "Field Name", ""),
    ('{"Garden plot":"x"}', "Garden plot", ""),
    ('{"list":"x","title":"Age","comment":"c"}', "Age", "c"),
    ('[1,null,"Age",{"label":"Age","description":"d"}]', "Age", "d"),
    ('{"list":[{"label":"Age","value":"9"}]}', "Age", ""),
    ('{"f1":{"question_title":"Quiz Score","value_text":"7"}}', "Quiz Score", ""),
    (None, "Age", ""),
    ('{"list":[{"question_title":"Ваше имя","value_text":"Иван"}]}', "ваше ИМЯ", "Иван"),
    ('{"list":[{"title":"a 100 b","value":"w"}]}', "100%b", "w"),
    ('{"list":[{"title":"100","name":"b","value":"w"}]}', "100%b", ""),
    ('{"list":[{"title":"order-no","value":"w"}]}', "order_no", "w"),
    (QUOTED, "Field's \"Name\"", "q"),
    (QUOTED, "a\\b", "s"),
    ('{"list":[{"title":"An unusually long question title","value":"cut"}]}', LONG, ""),
    ('{"title":"Age","title":"Size","value":"last"}', "Size", "last"),
    ('{"title":"Age","title":"Size","value":"last"}', "Age", ""),
    ("{bad", "Age", ""),
    ("null", "Age", ""),
    ('"Age"', "Age", ""),
    ('{"list":[{"Title":"Age","value":"case"}]}', "Age", ""),
    ('{"list":[{"title":"Age","value":{"b":1,"a":[true]}}]}', "Age", '{"a":[true],"b":1}'),
    ('{"list":[{"title":"Age","value":41}]}', "Age", "41"),
    ('{"list":[{"title":"a","name":"b","value":"two keys"}]}', "ab", ""),
    ('{"list":[{"value":"no title"}]}', "", ""),
    ('{"list":[{"title":"","value":"any title"}]}', "", "any title"),
    ('{"list":[{"title":"Age\\u0001x","value":"mark"}]}', "e\u0001x", "mark"),
    ('{"list":[],"title":"Age","value":"root"}', "Age", "root"),
]


def test_documented_cases(spark):
    titles = list(dict.fromkeys(title for _, title, _ in CASES))
    rows = [(i, doc) for i, (doc, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id INT, answers STRING")
    wide = fields_as_columns(df, "answers", titles)
    names = field_names(titles)
    got = {r["id"]: r for r in wide.collect()}
    for i, (doc, title, expected) in enumerate(CASES):
        assert got[i][names[titles.index(title)]] == expected, (doc, title)


def test_one_title_at_a_time(spark):
    for doc, title, expected in CASES[9:30]:
        df = spark.createDataFrame([(doc,)], "answers STRING")
        row = fields_as_columns(df, "answers", [title]).first()
        assert row[1] == expected, (doc, title)


@pytest.mark.parametrize(
    "title, index, name",
    [
        ("Garden plot", 0, "garden_plot"),
        ("Contact?!", 1, "contact"),
        ("Hours watered (last week)", 2, "hours_watered__last_week"),
        ("", 3, "field_3"),
        ("7th bed", 4, "field_7th_bed"),
        (
            "One word after another until the name is longer than a column may be",
            5,
            "one_word_after_another_until_the_name_is_longer_5",
        ),
        ("  spaced \t out ", 6, "spaced_out"),
        ("Ваше имя?", 7, "ваше_имя"),
        ("!!!", 8, "field_8"),
    ],
)
def test_safe_names(title, index, name):
    assert safe_name(title, index, max_length=50) == name


def test_long_titles_are_whole_unless_cut(spark):
    doc = '{"list":[{"title":"An unusually long question title","value":"cut"}]}'
    df = spark.createDataFrame([(doc,)], "answers STRING")
    assert fields_as_columns(df, "answers", [LONG], pattern_length=30).first()[1] == "cut"
    assert fields_as_columns(df, "answers", [LONG]).first()[1] == ""
    assert len(safe_name("n" * 200, 0)) == 200


def test_a_column_is_never_replaced(spark):
    df = spark.createDataFrame([("kept", '{"title":"Name","value":"found"}')], "name STRING, answers STRING")
    wide = fields_as_columns(df, "answers", ["Name"])
    assert (wide.columns, tuple(wide.first())[::2]) == (["name", "answers", "name_0"], ("kept", "found"))


def test_repeated_names_get_their_position():
    assert field_names(["A b", "a  b", "A_B"]) == ["a_b", "a_b_1", "a_b_2"]


def test_several_columns_and_positions(spark):
    df = spark.createDataFrame([(1, LIST, ARRAY)], "id INT, a STRING, b STRING")
    wide = fields_as_columns(df, {"a": ["Garden plot"], "b": ["Crops", "garden plot"]})
    assert wide.columns == ["id", "a", "b", "garden_plot", "crops", "garden_plot_2"]
    row = wide.select("crops", "id", "garden_plot", "garden_plot_2").first()
    assert tuple(row) == ("leek; kale", 1, "Row 12", "")


def test_column_types_that_are_not_text(spark):
    df = spark.createDataFrame([(LIST,)], "t STRING").select(
        F.try_parse_json("t").alias("v"),
        F.from_json("t", "list array<struct<question string, text string>>").alias("s"),
    )
    for column in ("v", "s"):
        assert fields_as_columns(df, column, ["contact"]).first()["contact"] == "plots@example.org"


def test_custom_keys(spark):
    doc = '{"list":[{"ask":"Age","reply":"9","value":"no"}]}'
    df = spark.createDataFrame([(doc,), (doc.replace('{"list":', "")[:-1],)], "j STRING")
    wide = fields_as_columns(df, "j", ["age"], value_keys=["reply"], match_keys=["ask"])
    assert [r["age"] for r in wide.collect()] == ["9", "9"]
    wide = fields_as_columns(df, "j", ["age"], name_key="ask", value_key="reply", mode="keys")
    assert [r["age"] for r in wide.collect()] == ["9", "9"]
    wide = fields_as_columns(df, "j", ["age"], name_key="ask", value_key="reply")
    assert [r["age"] for r in wide.collect()] == ["", ""]


def test_keys_that_differ_in_case(spark):
    docs = ['[{"Name":"Age","name":"Size","v":"1"}]', '[{"name":"Size"},{"Name":"Age","v":"2"}]']
    df = spark.createDataFrame([(d,) for d in docs], "j STRING")
    wide = fields_as_columns(df, "j", ["age", "size"], match_keys=["name", "Name"], value_keys=["v"])
    assert [tuple(r) for r in wide.select("age", "size").collect()] == [("1", "1"), ("2", "")]
    pivot = unnest_pivot(df, "j", "name", "Name", ["Size"])
    assert [r["size"] for r in pivot.collect()] == ["Age", None]


def test_nested_column_and_no_titles(spark):
    df = spark.createDataFrame([(LIST,)], "t STRING").select(F.struct("t").alias("payload"))
    assert fields_as_columns(df, "payload.t", ["contact"]).first()["contact"] == "plots@example.org"
    assert fields_as_columns(df, "payload.t", []).columns == ["payload"]


def test_optional_strategies(spark):
    docs = ['{"it\'s":"1","say \\"x\\"":"2","b\'\\"":"3","n":null}', '[["Age","41"],["Size"]]', LIST]
    df = spark.createDataFrame([(d,) for d in docs], "j STRING")
    titles = ["it's", 'say "x"', "b'\"", "n", "age", "size", "Garden plot"]
    chosen = [S.nested_list(), S.direct_field(), S.flexible_array(), S.positional()]
    rows = fields_as_columns(df, "j", titles, strategies=chosen).drop("j").collect()
    assert tuple(rows[0]) == ("1", "2", "3", "", "", "", "")
    assert tuple(rows[1]) == ("", "", "", "", "41", "", "")
    assert rows[2][6] == "Row 12"
    assert S.strategy_names(chosen) == ["nested_list", "direct_field", "flexible_array", "positional"]


def test_own_strategy(spark):
    def upper_key(doc, title):
        return F.try_variant_get(doc, f"$.{title.upper()}", "string")

    only = S.Strategy("only_age", upper_key, applies=lambda t: t == "age")
    df = spark.createDataFrame([('{"AGE":"7","SIZE":"8"}',)], "j STRING")
    chosen = [*S.default_strategies(), only]
    row = fields_as_columns(df, "j", ["age", "size"], strategies=chosen).first()
    assert (row["age"], row["size"]) == ("7", "")
    assert [s.name for s in S.applicable(chosen, "size")] == ["nested_list", "flexible_array"]
    row = fields_as_columns(df, "j", ["age", "size"], strategies=[upper_key], default=None).first()
    assert (row["age"], row["size"]) == ("7", "8")


def test_exact_title(spark):
    docs = [
        '{"f1":{"question_title":"Quiz Score","value_text":"7"},"x":3}',
        '{"long":{"question_title":"T","value_text":"late"},"b":{"question_title":"T","value_text":"first"}}',
        '{"a":{"question_title":"T"},"b":{"question_title":"T","value_text":"second"}}',
        "[1]",
        None,
    ]
    df = spark.createDataFrame([(d,) for d in docs], "j STRING")
    wide = fields_as_columns(df, "j", ["Quiz Score", "T", "quiz score"], strategies=[S.exact_title()], default=None)
    assert [tuple(r)[1:] for r in wide.collect()] == [
        ("7", None, None), (None, "first", None), (None, None, None), (None,) * 3, (None,) * 3,
    ]


def test_hidden_email(spark):
    docs = ['{"hidden":{"email":"h"},"email":"r"}', '{"Email":"R"}', '{"hidden":{"EMAIL":"H"}}', "{}", None]
    df = spark.createDataFrame([(d,) for d in docs], "j STRING")
    got = df.select(S.hidden_email(F.try_parse_json("j")).alias("e")).collect()
    assert [r["e"] for r in got] == ["h", "R", "H", "", ""]


def test_unknown_mode(spark):
    df = spark.createDataFrame([("{}",)], "j STRING")
    with pytest.raises(ValueError):
        fields_as_columns(df, "j", ["a"], mode="other")
    with pytest.raises(ValueError):
        fields_as_columns(df, "j", ["a"], mode="keys", name_key="n")
