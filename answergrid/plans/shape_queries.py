"""Unnesting and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.operators import (
    candidate_titles,
    json_schema,
    profile_all_paths,
    profile_json,
    unnest_entries,
    unnest_pivot,
    unnest_positional,
    unnest_rows,
)
from answergrid.plans import inputs
from answergrid.plans.inputs import array_of, item, list_of, object_of
from answergrid.plans.registry import documents_of, query, table


@query(
    """
    SELECT doc_id, CAST(unnest(range(len(lines))) AS INTEGER) AS pos, unnest(lines) AS value
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    """
)
def unnest_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of every document text."""
    lines = F.to_json(F.split("text", "\n", -1))
    df = documents_of(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return unnest_rows(df, "lines")


@query(
    """
    SELECT o_orderkey, 0 AS pos, 'Order status' AS question_title, o_orderstatus AS value_text FROM orders
    UNION ALL SELECT o_orderkey, 1, NULL, NULL FROM orders
    UNION ALL SELECT o_orderkey, 2, NULL, NULL FROM orders
    UNION ALL SELECT o_orderkey, 3, NULL, NULL FROM orders
    UNION ALL SELECT o_orderkey, 4, NULL, NULL FROM orders
    """
)
def unnest_record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of a list, its keys as columns."""
    df = inputs.order_answers(spark, sf_dir)
    return unnest_rows(df, "answers", "$.list", ["question_title", "value_text"])


@query(
    """
    SELECT event_id, 'k' AS "key", json_extract_string(props, '$.k') AS value FROM events
    UNION ALL SELECT event_id, 'type', event_type FROM events
    """
)
def unnest_object_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry of an object."""
    both = F.concat(
        F.expr("left(props, length(props) - 1)"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}')
    )
    df = documents_of(spark, sf_dir, "events").select("event_id", both.alias("props"))
    return unnest_entries(df, "props")


def _order_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between one and four records per order."""
    n = F.col("o_orderkey") % 4
    survey = array_of(
        item(question="Status", answer=F.col("o_orderstatus")),
        F.when(n >= 1, item(question="Priority", answer=F.col("o_orderpriority"))),
        F.when(n >= 2, item(question="Customer", answer=F.col("o_custkey"))),
        F.when(n >= 3, item(question="Order")),
    )
    return documents_of(spark, sf_dir, "orders").select("o_orderkey", survey.alias("survey"))


_POSITIONAL = """
    SELECT o_orderkey,
           'Status' AS survey_question_1, o_orderstatus AS survey_answer_1,
           CASE WHEN o_orderkey % 4 >= 1 THEN 'Priority' END AS survey_question_2,
           CASE WHEN o_orderkey % 4 >= 1 THEN o_orderpriority END AS survey_answer_2,
           CASE WHEN o_orderkey % 4 >= 2 THEN 'Customer' END AS survey_question_3,
           CASE WHEN o_orderkey % 4 >= 2 THEN CAST(o_custkey AS VARCHAR) END AS survey_answer_3
           {more}
    FROM orders
"""


@query(
    _POSITIONAL.format(
        more=""", CASE WHEN o_orderkey % 4 >= 3 THEN 'Order' END AS survey_question_4,
           CAST(NULL AS VARCHAR) AS survey_answer_4"""
    )
)
def unnest_positional_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered columns for the longest list, found by one more pass."""
    df = _order_survey(spark, sf_dir)
    return unnest_positional(df, "survey", "question", "answer").drop("survey")


@query(_POSITIONAL.format(more=""))
def unnest_positional_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered columns for three items: the number is the caller's."""
    df = _order_survey(spark, sf_dir)
    return unnest_positional(df, "survey", "question", "answer", 3).drop("survey")


@query(
    """
    SELECT o_orderkey, o_orderstatus AS status,
           CASE WHEN o_orderkey % 4 >= 1 THEN o_orderpriority END AS priority,
           CAST(NULL AS VARCHAR) AS absent
    FROM orders
    """
)
def unnest_pivot_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per given name."""
    df = _order_survey(spark, sf_dir)
    return unnest_pivot(df, "survey", "question", "answer", ["Status", "Priority", "Absent"]).drop(
        "survey"
    )


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS field_1_urgent,
           CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderstatus END AS field_2_high,
           CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderstatus END AS field_3_medium,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderstatus END AS field_4_not_specified,
           CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END AS field_5_low
    FROM orders
    """
)
def unnest_pivot_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per name that occurs; the first of repeated names wins."""
    survey = list_of(
        item(name=F.col("o_orderpriority"), value=F.col("o_orderstatus")),
        item(name=F.col("o_orderpriority"), value="second"),
    )
    df = documents_of(spark, sf_dir, "orders").select("o_orderkey", survey.alias("survey"))
    return unnest_pivot(df, "survey", "name", "value").drop("survey")


@query(
    """
    SELECT '$' AS path, 'object' AS kind, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS sample FROM events
    UNION ALL
    SELECT '$.k', 'number', count(*), min(json_extract_string(props, '$.k')) FROM events
    """
)
def profile_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the property documents of events hold."""
    return profile_json(documents_of(spark, sf_dir, "events"), "props")


_DEEP_SQL = """
    SELECT path, kind, count(*) AS n_rows, min(t) AS least, max(t) AS greatest, min(x) AS least_number, max(x) AS greatest_number
    FROM (
        SELECT '$' AS path, 'object' AS kind, NULL::VARCHAR AS t, NULL::DOUBLE AS x FROM lineitem
        UNION ALL SELECT '$.a', 'object', NULL, NULL FROM lineitem
        UNION ALL SELECT '$.a.b', 'array', NULL, NULL FROM lineitem
        UNION ALL SELECT '$.a.b[*]', CASE WHEN l_linenumber = 1 THEN 'number' ELSE 'object' END, NULL,
                         CASE WHEN l_linenumber = 1 THEN l_orderkey END FROM lineitem
        UNION ALL SELECT '$.a.b[*].c', 'array', NULL, NULL FROM lineitem WHERE l_linenumber <> 1
        UNION ALL SELECT '$.a.b[*].c[*]', 'object', NULL, NULL FROM lineitem WHERE l_linenumber <> 1
        UNION ALL SELECT '$.a.b[*].c[*].flag', 'string', l_returnflag, NULL FROM lineitem WHERE l_linenumber <> 1
        UNION ALL SELECT '$.a.b[*].c[*].open', 'boolean', CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END, NULL
                  FROM lineitem WHERE l_linenumber <> 1
        UNION ALL SELECT '$.a.b[*].c[*].size', 'object', NULL, NULL FROM lineitem WHERE l_linenumber <> 1
        UNION ALL SELECT '$.a.b[*].c[*].size.quantity', 'number', NULL, l_quantity FROM lineitem WHERE l_linenumber <> 1
        UNION ALL SELECT '$.a.b[*].c[*].size.none', 'null', NULL, NULL FROM lineitem WHERE l_linenumber <> 1
    )
    GROUP BY path, kind
"""


@query(_DEEP_SQL)
def profile_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of documents nested six levels deep, with its kinds, counts and extremes."""
    size = object_of(quantity=F.col("l_quantity").cast("string"), none=F.lit("null"))
    inner = object_of(
        flag=inputs.text_of(F.col("l_returnflag")),
        open=F.when(F.col("l_linestatus") == "O", "true").otherwise("false"),
        size=size,
    )
    item_ = F.when(F.col("l_linenumber") == 1, F.col("l_orderkey").cast("string")).otherwise(object_of(c=array_of(inner)))
    df = documents_of(spark, sf_dir, "lineitem").select(object_of(a=object_of(b=array_of(item_))).alias("doc"))
    return profile_all_paths(df, "doc")


@query(
    """
    WITH d AS (SELECT doc_id, text, lang, n_chars, doc_id % 3 AS shape FROM documents)
    SELECT '$' AS path,
           CASE WHEN shape = 0 THEN 'array' WHEN shape = 1 THEN 'object' ELSE 'string' END AS kind,
           count(*) AS n_rows, min(CASE WHEN shape = 2 AND len(lang) < 100 THEN lang END) AS sample
    FROM d GROUP BY 2
    UNION ALL SELECT '$[*]', 'object', count(*), NULL FROM d WHERE shape = 0
    UNION ALL SELECT '$[*]', 'null', count(*), NULL FROM d WHERE shape = 0
    UNION ALL SELECT '$[*].text', 'string', count(*), min(CASE WHEN len(text) < 100 THEN text END)
    FROM d WHERE shape = 0
    UNION ALL SELECT '$[*].n', 'number', count(*), min(CAST(n_chars AS VARCHAR)) FROM d WHERE shape = 0
    UNION ALL SELECT '$.lang', 'string', count(*), min(lang) FROM d WHERE shape = 1
    UNION ALL SELECT '$.short', 'boolean', count(*), min(CAST(n_chars < 500 AS VARCHAR)) FROM d WHERE shape = 1
    """
)
def profile_mixed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, objects and bare texts in one column of whole documents."""
    shape = F.col("doc_id") % 3
    doc = (
        F.when(shape == 0, array_of(item(text=F.col("text"), n=F.col("n_chars")), F.lit("null")))
        .when(shape == 1, item(lang=F.col("lang"), short=F.col("n_chars") < 500))
        .otherwise(F.concat(F.lit('"'), F.col("lang"), F.lit('"')))
    )
    return profile_json(documents_of(spark, sf_dir, "documents").select(doc.alias("doc")), "doc", sample_length=99)


@query(
    """
    SELECT 'OBJECT<' || string_agg(k || ': BIGINT', ', ' ORDER BY k) || '>' AS json_schema
    FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events)
    """
)
def column_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common schema of a whole column."""
    return json_schema(documents_of(spark, sf_dir, "events"), "props")


@query(
    """
    SELECT '$.list[*].question' AS key_path, title, count(*) AS n
    FROM (
        SELECT 'Что: ' || r_name AS title FROM region
        UNION ALL SELECT n_name FROM nation
        UNION ALL SELECT o_orderpriority FROM orders
    ) WHERE title LIKE 'Что%' OR len(title) > 10
    GROUP BY title
    """
)
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look like titles, by prefix or length, over three tables."""
    titles = (
        table(spark, sf_dir, "region").select(F.concat(F.lit("Что: "), "r_name").alias("t"))
        .unionAll(table(spark, sf_dir, "nation").select("n_name"))
        .unionAll(documents_of(spark, sf_dir, "orders").select("o_orderpriority"))
    )
    answers = list_of(item(question=F.col("t"), number=F.lit(12345678901)))
    return candidate_titles(titles.select(answers.alias("answers")), "answers", path="$.list")


@query(
    """
    SELECT c_custkey, c_name AS survey_responses_question_1, c_mktsegment AS survey_responses_answer_1
    FROM customer
    """
)
def unnest_positional_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list under another key, with its own column prefix."""
    doc = object_of(
        survey_responses=array_of(item(question=F.col("c_name"), answer=F.col("c_mktsegment")))
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", doc.alias("survey_data"))
    return unnest_positional(
        df, "survey_data", "question", "answer",
        path="$.survey_responses", prefix="survey_responses",
    ).drop("survey_data")
