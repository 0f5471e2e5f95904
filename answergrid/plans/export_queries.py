"""Export, and the relational queries an export may be made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.functions import documents
from answergrid.operators import (
    ROW_CAP,
    as_text,
    capped,
    fields_as_columns,
    header_of,
    latest_per_entity,
    missing_by_day,
)
from answergrid.plans import inputs
from answergrid.plans.registry import documents_of, query, table
from answergrid.sources import new_path, read_export, read_grid, read_query, write_grid
from answergrid.sources.grids import BATCH_ROWS


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS o_orderdate,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS status,
           CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS even,
           strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM orders
    """
)
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, times, days, booleans and NULL as cell text."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        "o_orderdate",
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"),
        (F.col("o_custkey") % 2 == 0).alias("even"),
        F.to_date("o_orderdate").alias("day"),
    )
    return as_text(orders)


@query(
    """
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts, CAST(value AS VARCHAR) AS value, props
    FROM events
    """
)
def export_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with a fraction, as a zone-aware instant."""
    events = table(spark, sf_dir, "events")
    return as_text(events.select("event_id", "ts", "value", "props"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 50000
    """
)
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual cap on a sorted result."""
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"]
    lines = capped(table(spark, sf_dir, "lineitem"), ROW_CAP, order=order)
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
           CAST(l_partkey AS VARCHAR) AS l_partkey, l_returnflag
    FROM lineitem
    """
)
def export_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export without a limit is whole."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    path = new_path(spark, "lines")
    write_grid(lines, path)
    return read_export(spark, path, header_of(lines))


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text FROM documents")
def export_texts_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks and quotes come back as they were."""
    documents_table = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "texts")
    write_grid(documents_table, path)
    return read_export(spark, path, header_of(documents_table))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 1000
    """
)
def row_cap_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of the caller's on the largest table."""
    lines = table(spark, sf_dir, "lineitem")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    return capped(lines, 1000, order=order).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """
    SELECT least(count(*), 20000) AS n_rows, TRUE AS all_known
    FROM lineitem
    """
)
def row_cap_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap on the largest table where any rows will do."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").select(*keys)
    taken = capped(lines, 20_000).groupBy(*keys).agg(F.count("*").alias("taken"))
    # The cap bounds the broadcast side, so the table itself is not shuffled.
    found = lines.join(F.broadcast(taken), keys).groupBy(*keys, "taken").agg(F.count("*").alias("n"))
    return found.agg(
        F.sum("taken").alias("n_rows"), F.bool_and(F.col("taken") <= F.col("n")).alias("all_known")
    )


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority AS priority,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS o_orderdate
    FROM orders
    """
)
def export_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract, write all rows as grid files with headers, read them back."""
    orders = documents_of(spark, sf_dir, "orders")
    df = orders.select("o_orderkey", "o_orderdate", inputs.order_json().alias("answers"))
    result = fields_as_columns(df, "answers", ["priority"]).select(
        "o_orderkey", "priority", "o_orderdate"
    )
    path = new_path(spark, "export")
    write_grid(result, path, order=["o_orderkey"])
    return read_export(spark, path, header_of(result))


@query(
    """
    SELECT CAST(ceil(count(*) / 10000.0) AS BIGINT) AS least_batches,
           TRUE AS within_batch, count(*) AS n_rows, sum(l_orderkey)::BIGINT AS key_sum
    FROM lineitem
    """
)
def export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items in files of at most 10,000 rows, without headers."""
    path = new_path(spark, "batches")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    write_grid(lines, path, include_headers=False, batch_rows=BATCH_ROWS)
    grid = read_grid(spark, path, width=3)
    files = grid.groupBy("row_no.file").agg(
        F.count("*").alias("n"), F.sum(F.get("cells", F.lit(0)).cast("long")).alias("keys")
    )
    return files.agg(
        F.ceil(F.sum("n") / 10000.0).alias("least_batches"),
        ((F.max("n") <= 10000) & (F.count("*") >= F.ceil(F.sum("n") / 10000.0))).alias("within_batch"),
        F.sum("n").alias("n_rows"),
        F.sum("keys").alias("key_sum"),
    )


@query(
    """
    SELECT CAST(ts AS DATE) AS date, count(*) AS total_responses,
           count(*) FILTER (event_id % 10 = 0) AS missing_values
    FROM events
    WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY
    GROUP BY 1 ORDER BY 1 DESC
    """
)
def missing_by_day_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty addresses per day over the last week of events."""
    answers = F.when(F.col("event_id") % 10 == 0, F.lit("{}")).otherwise(
        inputs.object_of(hidden=inputs.item(email=F.col("event_type")))
    )
    events = table(spark, sf_dir, "events").select("ts", answers.alias("answers"))
    parsed = events.withColumn("doc", documents.document_of(events, "answers"))
    email = F.coalesce(documents.field_text(F.col("doc"), "email", "$.hidden"), F.lit(""))
    emails = parsed.select("ts", email.alias("email"))
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return missing_by_day(emails, "ts", "email", as_of=as_of)


@query(
    """
    SELECT c_custkey, c_name, c_nationkey, c_mktsegment AS segment
    FROM customer WHERE c_mktsegment ILIKE '%mach%' AND c_nationkey = 3
    """
)
def select_filter_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column list without one column, an alias, ILIKE, equality and AND."""
    return read_query(
        spark,
        """
        SELECT * EXCEPT (c_acctbal, c_mktsegment), c_mktsegment AS segment FROM {customer}
        WHERE c_mktsegment ILIKE '%mach%' AND c_nationkey = 3
        """,
        customer=table(spark, sf_dir, "customer"),
    )


@query(
    """
    SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue,
           count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate > DATE '1998-01-01' AND o_orderpriority IS NOT NULL
    GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY c_mktsegment
    """
)
def join_filter_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join with a date filter, grouped and filtered again."""
    orders = table(spark, sf_dir, "orders").where(
        "o_orderdate > TIMESTAMP_NTZ '1998-01-01' AND o_orderpriority IS NOT NULL"
    )
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "inner")
    grouped = joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )
    return grouped.where("n_orders > 10").orderBy("c_mktsegment")


@query(
    """
    SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n,
           count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open
    FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 DESC
    """
)
def group_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day, newest first."""
    return read_query(
        spark,
        """
        SELECT to_date(o_orderdate) AS day, count(*) AS n,
               count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open
        FROM {orders} GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 DESC
        """,
        orders=table(spark, sf_dir, "orders"),
    )


@query(
    """
    SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus
    FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC
    """
)
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of every customer."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"
    )
    return latest_per_entity(orders, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(
    """
    WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000)
    SELECT n_name, count(*) AS n FROM (
        SELECT n_name FROM big JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
    ) GROUP BY n_name ORDER BY n DESC, n_name LIMIT 5
    """
)
def common_table_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CTE, a subquery, two joins and a top five."""
    return read_query(
        spark,
        """
        WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 400000)
        SELECT n_name, count(*) AS n FROM (
            SELECT n_name FROM big JOIN {customer} ON o_custkey = c_custkey
            JOIN {nation} ON c_nationkey = n_nationkey
        ) GROUP BY n_name ORDER BY n DESC, n_name LIMIT 5
        """,
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"),
    )


@query(
    """
    SELECT o_orderkey, unnest(['Order status', 'Order priority']) AS title,
           unnest([o_orderstatus, o_orderpriority]) AS value
    FROM orders
    UNION ALL
    SELECT o_orderkey, unnest(['Customer number', 'Order date', 'Order number']),
           unnest([CAST(o_custkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), CAST(o_orderkey AS VARCHAR)])
    FROM orders
    """
)
def lateral_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array elements beside their row, in SQL."""
    documents.configure(spark)
    orders = documents_of(spark, sf_dir, "orders").select(
        "o_orderkey", inputs.order_json().alias("answers")
    )
    return read_query(
        spark,
        """
        SELECT o_orderkey,
               coalesce(e:question_title::string, e:title::string, e:question::string, e:name::string) AS title,
               coalesce(e:value_text::string, e:answer::string, e:text::string, e:value::string,
                        e:response::string) AS value
        FROM (SELECT o_orderkey, try_parse_json(answers) AS doc FROM {orders})
        LATERAL VIEW posexplode(try_variant_get(doc, '$.list', 'array<variant>')) x AS pos, e
        """,
        orders=orders,
    )


@query(
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k_text,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           CASE WHEN lower(event_type) LIKE '%e%' THEN 'e' ELSE coalesce(event_type, '') END AS kind,
           TRUE AS has_k, 'object' AS root, 'number' AS k_kind, CAST(value AS VARCHAR) AS value_text
    FROM events
    """
)
def json_and_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key lookup, key test, kinds, casts, CASE, COALESCE, LOWER and LIKE."""
    events = documents_of(spark, sf_dir, "events")
    parsed = events.withColumn("doc", documents.document_of(events, "props"))
    doc = F.col("doc")
    lowered = F.lower("event_type")
    return parsed.select(
        "event_id",
        documents.field_text(doc, "k").alias("k_text"),
        F.try_variant_get(doc, "$.k", "bigint").alias("k"),
        F.when(lowered.like("%e%"), "e").otherwise(F.coalesce("event_type", F.lit(""))).alias("kind"),
        F.array_contains(F.json_object_keys("props"), "k").alias("has_k"),
        documents.kind(doc).alias("root"),
        documents.kind(F.try_variant_get(doc, "$.k", "variant")).alias("k_kind"),
        F.col("value").cast("string").alias("value_text"),
    )
