"""Field extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.functions import documents, matching, strategies
from answergrid.operators import fields_as_columns, many_fields, register_field_table, register_sql_functions
from answergrid.plans import inputs
from answergrid.plans.inputs import array_of, item, list_of, object_of, text_of
from answergrid.plans.registry import documents_of, query, table


@query(
    """
    SELECT conv_id, turn, role AS speaker_role, text AS message_text,
           CAST(turn AS VARCHAR) AS position_in_the_conversation, '' AS mood
    FROM conversations
    """
)
def fields_as_columns_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as an answer; whole texts, one title missing."""
    titles = ["Speaker Role", "message text", "Position in the conversation", "Mood"]
    return fields_as_columns(inputs.turn_answers(spark, sf_dir), "answers", titles).drop("answers")


@query(
    """
    SELECT o_orderkey, o_orderstatus AS order_status, o_orderpriority AS priority,
           CAST(o_custkey AS VARCHAR) AS customer,
           strftime(o_orderdate, '%Y-%m-%d') AS "date",
           CAST(o_orderkey AS VARCHAR) AS order_number,
           o_orderstatus AS "order", '' AS unknown
    FROM orders
    """
)
def fields_as_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All title and value keys of the list shape; ``order`` takes the first match."""
    titles = ["ORDER STATUS", "priority", "customer", "date", "order number", "order", "unknown"]
    return fields_as_columns(inputs.order_answers(spark, sf_dir), "answers", titles).drop("answers")


@query(
    """
    SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS line_orderkey_0,
           CAST(l_partkey AS VARCHAR) AS line_partkey_0,
           CAST(l_suppkey AS VARCHAR) AS line_suppkey_0,
           CAST(l_linenumber AS VARCHAR) AS line_linenumber_0,
           CAST(l_quantity AS VARCHAR) AS line_quantity_0,
           CAST(l_extendedprice AS VARCHAR) AS line_extendedprice_0,
           CAST(l_discount AS VARCHAR) AS line_discount_0,
           CAST(l_tax AS VARCHAR) AS line_tax_0,
           l_returnflag AS line_returnflag_0, l_linestatus AS line_linestatus_0,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS line_shipdate_0
    FROM lineitem
    """
)
def fields_as_columns_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven titles from documents of eleven records, on the largest table."""
    df = inputs.lineitem_answers(spark, sf_dir)
    return fields_as_columns(df, "answers", inputs.lineitem_titles(spark, sf_dir)).drop("answers")


@query(
    """
    SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS line_partkey_0,
           CAST(l_extendedprice AS VARCHAR) AS line_extendedprice_1, l_returnflag AS line_returnflag_2,
           '' AS line_tax_99, 33 AS n_found
    FROM lineitem
    """
)
def many_titles_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred titles from documents of 33 records, all at once."""
    df = inputs.lineitem_answers(spark, sf_dir, repeats=3)
    titles = inputs.lineitem_titles(spark, sf_dir, repeats=3)
    titles += [f"line tax {i}" for i in range(3, 270)]
    wide = many_fields(df, "answers", titles).drop("answers")
    shown = ["line_partkey_0", "line_extendedprice_1", "line_returnflag_2", "line_tax_99"]
    return wide.select("l_orderkey", "l_linenumber", *shown, F.size(F.array_remove(F.array(*wide.columns[2:]), "")).alias("n_found"))


@query(
    """
    SELECT o_orderkey, o_orderpriority AS value_a, o_orderstatus AS value_b,
           '' AS absent
    FROM orders
    """
)
def nested_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list strategy alone, as an expression."""
    df = inputs.order_answers(spark, sf_dir).withColumn("doc", F.try_parse_json("answers"))
    found = strategies.nested_list()
    return df.select(
        "o_orderkey",
        found.value(F.col("doc"), "order priority").alias("value_a"),
        found.value(F.col("doc"), "STATUS").alias("value_b"),
        F.coalesce(found.value(F.col("doc"), "none such"), F.lit("")).alias("absent"),
    )


@query(
    """
    SELECT c_custkey,
           c_name AS customer_name,
           c_mktsegment AS segment,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS nation
    FROM customer
    """
)
def flexible_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root arrays and root objects, found by ``label`` and ``key`` as well."""
    nation = F.when(
        F.col("c_custkey") % 3 != 0, item(key="Nation", comment=F.col("c_nationkey"))
    )
    answers = array_of(
        F.lit("17"),
        F.lit("null"),
        item(label="Customer name", response=F.col("c_name")),
        item(label="Segment", description=F.col("c_mktsegment")),
        nation,
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", answers.alias("answers"))
    chosen = [strategies.flexible_array()]
    titles = ["customer name", "segment", "nation"]
    return fields_as_columns(df, "answers", titles, strategies=chosen).drop("answers")


@query(
    """
    SELECT o_orderkey,
           CASE o_orderkey % 8
               WHEN 0 THEN o_orderpriority
               WHEN 1 THEN o_orderstatus
               WHEN 2 THEN o_orderpriority
               WHEN 3 THEN ''
               WHEN 4 THEN o_orderstatus
               WHEN 5 THEN ''
               WHEN 6 THEN o_orderpriority
               ELSE '' END AS priority
    FROM orders
    """
)
def strategy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight document shapes: which part decides, and what ends the search."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    shapes = [
        # The list decides even when the root matches too.
        object_of(
            title=F.lit('"Priority"'),
            value=F.lit('"root"'),
            list=array_of(item(title="Priority", value=priority)),
        ),
        # No match in the list: the root does, value before text.
        object_of(
            list=F.lit('[{"title":"Other"}]'),
            name=F.lit('"priority"'),
            text=F.lit('"x"'),
            value=text_of(status),
        ),
        # Null is skipped.
        list_of(
            object_of(
                value_text=F.lit("null"), title=F.lit('"Priority"'), answer=text_of(priority)
            )
        ),
        # An empty text is a value.
        list_of(item(title="Priority", value_text="", answer=priority)),
        # A root array: value before answer.
        array_of(item(title="Priority", answer=priority, value=status)),
        # A match without a value ends the search.
        F.lit('{"list":[{"title":"Priority"}],"title":"Priority","value":"root"}'),
        # A list: answer before value.
        list_of(item(title="Priority", answer=priority, value=status)),
    ]
    shape = F.lit('{"list":[{"label":"Priority","value":"label does not count here"}]}')
    for number, text in enumerate(shapes):
        shape = F.when(F.col("o_orderkey") % 8 == number, text).otherwise(shape)
    df = documents_of(spark, sf_dir, "orders").select("o_orderkey", shape.alias("answers"))
    return fields_as_columns(df, "answers", ["Priority"]).drop("answers")


@query(
    """
    SELECT o_orderkey, o_orderpriority AS the_priority_that_the_customer_chose,
           o_orderstatus AS the_priority_that_the_customer_rejected,
           o_orderpriority AS the_priority_that_the_customer_wished_for_every_single_time,
           o_orderpriority AS "order_100__by_customer", o_orderstatus AS "o_der_status",
           o_orderstatus AS a_b, '' AS field_1st
    FROM orders
    """
)
def title_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long titles are searched whole, or by their start if asked; ``%`` and ``_`` are wildcards."""
    answers = list_of(
        item(title="The priority that the customer chose", value=F.col("o_orderpriority")),
        item(title="The priority that the customer rejected", value=F.col("o_orderstatus")),
        item(title="order is 100 per cent by customer", value=F.col("o_orderpriority")),
        item(question="O-der status", text=F.col("o_orderstatus")),
        item(name="a\\b", value=F.col("o_orderstatus")),
    )
    titles = [
        "The priority that the customer chose",
        "The priority that the customer rejected",
        "order%100% by customer",
        "O_der status",
        "A\\B",
        "1st",
    ]
    df = documents_of(spark, sf_dir, "orders").select("o_orderkey", answers.alias("answers"))
    whole = fields_as_columns(df, "answers", titles)
    start = ["The priority that the customer wished for every single time"]
    cut = fields_as_columns(whole, "answers", start, pattern_length=matching.PATTERN_LENGTH)
    return cut.drop("answers")


@query(
    """
    SELECT doc_id, lang AS "язык_документа", source AS "источник", text AS "полный_текст"
    FROM documents
    """
)
def titles_in_other_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles outside Latin script, over whole document texts."""
    answers = list_of(
        item(question_title="Язык документа", value_text=F.col("lang")),
        item(question_title="Источник", value_text=F.col("source")),
        item(question_title="Полный текст", value_text=F.col("text")),
    )
    df = documents_of(spark, sf_dir, "documents").select("doc_id", answers.alias("answers"))
    titles = ["язык ДОКУМЕНТА", "источник", "ПОЛНЫЙ текст"]
    return fields_as_columns(df, "answers", titles).drop("answers")


@query(
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS missing
    FROM events
    """
)
def direct_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value under the title itself."""
    df = documents_of(spark, sf_dir, "events").select("event_id", "props")
    chosen = [strategies.direct_field()]
    return fields_as_columns(df, "props", ["k", "missing"], strategies=chosen).drop("props")


@query(
    """
    SELECT c_custkey, c_name AS name, c_mktsegment AS segment, '' AS nation
    FROM customer
    """
)
def positional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``[title, value]``."""
    answers = F.to_json(
        F.array(
            F.array(F.lit("Full name"), F.col("c_name"), F.lit("extra")),
            F.array(F.lit("Market segment"), F.col("c_mktsegment")),
            F.array(F.lit("Nation")),
        )
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", answers.alias("answers"))
    chosen = [strategies.positional()]
    titles = ["name", "segment", "nation"]
    return fields_as_columns(df, "answers", titles, strategies=chosen).drop("answers")


@query(
    """
    SELECT s_suppkey, s_name AS picked,
           s_nationkey % 2 = 0 AS matched,
           'A supplier title of more than thirty characters' AS pattern,
           left('A supplier title of more than thirty characters', 30) AS cut_pattern
    FROM supplier
    """
)
def value_pick_and_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two building blocks on a plain struct column."""
    record = F.struct(
        F.lit(None).cast("string").alias("value_text"),
        F.col("s_name").alias("answer"),
        F.lit("other").alias("text"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("Home NATION")).alias("title"),
        F.lit("supplier").alias("name"),
    )
    df = table(spark, sf_dir, "supplier").select("s_suppkey", record.alias("record"))
    title = "A supplier title of more than thirty characters"
    return df.select(
        "s_suppkey",
        matching.pick_value(F.col("record"), ["value_text", "answer", "text"]).alias("picked"),
        matching.matches(F.col("record"), ["title", "name"], "home nation").alias("matched"),
        F.lit(matching.make_pattern(title)).alias("pattern"),
        F.lit(matching.make_pattern(title, matching.PATTERN_LENGTH)).alias("cut_pattern"),
    )


@query(
    """
    SELECT c_custkey, c_name AS full_name,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS market_segment,
           CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS twice,
           CAST(NULL AS VARCHAR) AS "full"
    FROM customer
    """
)
def exact_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object of records, found by the whole title; NULL when absent."""
    segment = F.when(
        F.col("c_custkey") % 4 != 0,
        item(question_title="Market segment", value_text=F.col("c_mktsegment")),
    )
    early = F.when(F.col("c_custkey") % 3 == 0, item(question_title="Twice", value_text="first"))
    answers = object_of(
        aa=item(question_title="Twice", value_text="second"),
        z=early,
        n=F.lit("3"),
        name=item(question_title="Full name", value_text=F.col("c_name")),
        segment=segment,
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", answers.alias("answers"))
    titles = ["Full name", "Market segment", "Twice", "Full"]
    chosen = [strategies.exact_title()]
    return fields_as_columns(df, "answers", titles, strategies=chosen, default=None).drop("answers")


@query(
    """
    SELECT c_custkey,
           CASE c_custkey % 4 WHEN 0 THEN lower(c_name) WHEN 1 THEN c_name
                              WHEN 2 THEN upper(c_name) ELSE '' END AS email
    FROM customer
    """
)
def coalesce_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hidden address first, then one at the root, in any of three spellings."""
    name = F.col("c_name")
    hidden = object_of(hidden=item(email=F.lower(name)), email=F.lit('"root"'))
    answers = (
        F.when(F.col("c_custkey") % 4 == 0, hidden)
        .when(F.col("c_custkey") % 4 == 1, item(Email=name))
        .when(F.col("c_custkey") % 4 == 2, item(EMAIL=F.upper(name)))
        .otherwise(F.lit('{"hidden":{},"mail":"x"}'))
    )
    df = table(spark, sf_dir, "customer").select("c_custkey", answers.alias("answers"))
    email = strategies.hidden_email(documents.document_of(df, "answers"))
    return df.select("c_custkey", email.alias("email"))


@query(
    """
    SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status,
           c_name AS "name", c_mktsegment AS segment, '' AS status_4
    FROM orders JOIN customer ON o_custkey = c_custkey
    """
)
def multi_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two JSON columns of a join, each with its own titles."""
    orders = documents_of(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", inputs.order_json().alias("order_answers")
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        array_of(
            item(label="Name", value=F.col("c_name")),
            item(label="Segment", value=F.col("c_mktsegment")),
        ).alias("customer_answers"),
    )
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "inner")
    titles = {
        "order_answers": ["priority", "status"],
        "customer_answers": ["name", "segment", "status"],
    }
    wide = fields_as_columns(joined, titles)
    return wide.select("o_orderkey", "priority", "status", "name", "segment", "status_4")


@query(
    """
    SELECT o_orderkey, o_orderpriority AS priority
    FROM orders
    WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderstatus = 'F'
    ORDER BY o_orderpriority, o_orderkey DESC LIMIT 100
    """
)
def filter_extract_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter before extracting, sort and limit by what was extracted."""
    orders = documents_of(spark, sf_dir, "orders")
    df = orders.select("*", inputs.order_json().alias("answers")).where(
        "o_orderdate > TIMESTAMP_NTZ '1998-01-01' AND o_orderstatus = 'F'"
    )
    wide = fields_as_columns(df, "answers", ["priority"]).select("o_orderkey", "priority")
    return wide.orderBy("priority", F.col("o_orderkey").desc()).limit(100)


@query(
    """
    SELECT o_custkey, o_orderstatus AS status, o_orderkey, o_orderpriority AS priority
    FROM orders WHERE o_orderpriority LIKE '1%'
    """
)
def select_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted columns anywhere in the select list, and in a filter."""
    orders = documents_of(spark, sf_dir, "orders")
    df = orders.select("*", inputs.order_json().alias("answers"))
    wide = fields_as_columns(df, "answers", ["priority", "status"])
    return wide.where("priority LIKE '1%'").select("o_custkey", "status", "o_orderkey", "priority")


@query(
    """
    SELECT event_id, event_type AS type_of_event, json_extract_string(props, '$.k') AS k, 'none' AS other
    FROM events
    """
)
def custom_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's after the built-in strategies."""

    def nested_props(doc: Column, title: str) -> Column:
        return documents.field_text(doc, title, "$.props")

    answers = object_of(
        list=array_of(item(title="Type of event", value=F.col("event_type"))), props=F.col("props")
    )
    df = documents_of(spark, sf_dir, "events").select("event_id", answers.alias("answers"))
    chosen = [*strategies.default_strategies(), nested_props]
    wide = fields_as_columns(
        df, "answers", ["type of event", "k", "other"], strategies=chosen, default="none"
    )
    return wide.drop("answers")


@query(
    """
    SELECT p_partkey, p_brand AS brand, p_type AS "type", '' AS title
    FROM part
    """
)
def custom_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other title and value keys, in a list and in a root array."""
    items = [
        item(setting="Brand", choice=F.col("p_brand"), value="no"),
        item(setting="Type", choice=F.col("p_type"), title="title"),
    ]
    answers = F.when(F.col("p_partkey") % 2 == 0, list_of(*items)).otherwise(array_of(*items))
    df = table(spark, sf_dir, "part").select("p_partkey", answers.alias("answers"))
    wide = fields_as_columns(
        df, "answers", ["brand", "type", "title"], match_keys=["setting"], value_keys=["choice"]
    )
    return wide.drop("answers")


@query(
    """
    SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size
    FROM part
    """
)
def name_and_value_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name key and one value key chosen by the caller."""
    answers = array_of(
        item(setting="Brand", choice=F.col("p_brand")),
        item(setting="Size", choice=F.col("p_size")),
    )
    df = table(spark, sf_dir, "part").select("p_partkey", answers.alias("answers"))
    wide = fields_as_columns(
        df, "answers", ["brand", "size"], name_key="setting", value_key="choice", mode="keys"
    )
    return wide.drop("answers")


@query(
    """
    SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status,
           CAST(o_custkey AS VARCHAR) AS customer, '' AS nothing
    FROM orders WHERE o_orderpriority LIKE '%URGENT'
    """
)
def sql_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function in a select list and a filter."""
    register_sql_functions(spark)
    answers = inputs.order_answers(spark, sf_dir)
    return spark.sql(
        """
        SELECT o_orderkey, json_field(answers, 'Priority') AS priority,
               json_field(answers, 'STATUS') AS status,
               json_field(answers, 'Customer') AS customer,
               json_field(answers, 'nothing') AS nothing
        FROM {answers}
        WHERE json_field(answers, 'priority') LIKE '%URGENT'
        """,
        answers=answers,
    )


@query(
    """
    SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status,
           CAST(o_custkey AS VARCHAR) AS customer, '' AS nothing
    FROM orders WHERE o_orderpriority LIKE '%URGENT' OR o_orderstatus = 'F'
    """
)
def sql_field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled columns of a SQL table function: filters and select lists share one parse."""
    register_field_table(spark, "order_fields", ["Priority", "STATUS", "Customer", "nothing"])
    answers = inputs.order_answers(spark, sf_dir)
    return spark.sql(
        """
        SELECT o_orderkey, f.priority, f.status, f.customer, f.nothing
        FROM {answers} AS a, LATERAL order_fields(a.answers) AS f
        WHERE f.priority LIKE '%URGENT' OR f.status = 'F'
        """,
        answers=answers,
    )


@query(
    """
    SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status,
           CAST(o_custkey AS VARCHAR) AS customer, '' AS nothing
    FROM orders WHERE o_orderstatus <> 'F'
    """
)
def sql_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several titles in one SQL call: one parse, with a filter on one of them."""
    register_sql_functions(spark)
    answers = inputs.order_answers(spark, sf_dir)
    return spark.sql(
        """
        SELECT o_orderkey, found[0] AS priority, found[1] AS status,
               found[2] AS customer, found[3] AS nothing
        FROM (
            SELECT o_orderkey, array(
                json_fields(answers, array('Priority', 'STATUS', 'Customer', 'nothing'))
            ) AS once
            FROM {answers}
        ) LATERAL VIEW OUTER explode(once) AS found
        WHERE found[1] <> 'F'
        """,
        answers=answers,
    )
