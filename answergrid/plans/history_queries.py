"""Grids, histories and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.operators import (
    as_of,
    fields_as_columns,
    find_header,
    import_grid,
    latest_fields,
    latest_per_entity,
    pack_rows,
    project_fields,
    validity,
)
from answergrid.plans import inputs
from answergrid.plans.registry import documents_of, query, table
from answergrid.sources import (
    Run,
    append_history,
    append_history_files,
    append_load,
    ensure_history,
    import_files,
    new_path,
    read_grid,
    read_history_files,
    read_latest,
    read_loads,
    refresh_latest,
    write_grid,
    write_load,
)
from answergrid.streaming import append_stream, known_header, stream_files

FIELDS = ["segment", "No", "nation", "notes"]
LOADED_AT = datetime(2024, 1, 15, 10, 30)

# The rows of the customer grid that an import keeps.
_KEPT = """
    SELECT c_custkey, c_name AS entity_id,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment,
           CAST(c_custkey AS VARCHAR) AS "No",
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
           '' AS notes
    FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0
"""


def _stamp_text(df: DataFrame) -> DataFrame:
    in_utc = F.to_utc_timestamp("loaded_at_utc", F.current_timezone())
    stamp = F.date_format(in_utc, "yyyy-MM-dd HH:mm:ss")
    return df.withColumn("loaded_at_utc", stamp)


@query(
    """
    SELECT CAST(-1 AS BIGINT) AS row_no, 1 AS id_column, 2 AS segment_column, 3 AS nation_column,
           'notes' AS missing, count(*) AS rows_below FROM customer
    """
)
def header_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row, its columns and what it lacks."""
    grid = inputs.customer_grid(spark, sf_dir)
    header = find_header(grid, "customer_name", FIELDS)
    return grid.where(F.col("row_no") > header.row_no).agg(
        F.lit(header.row_no).cast("long").alias("row_no"),
        F.lit(header.columns["customer_name"]).alias("id_column"),
        F.lit(header.columns["segment"]).alias("segment_column"),
        F.lit(header.columns["nation"]).alias("nation_column"),
        F.lit(",".join(header.missing)).alias("missing"),
        F.count("*").alias("rows_below"),
    )


@query(
    f"""
    SELECT entity_id, segment, "No", nation, notes, '2024-01-15 10:30:00' AS loaded_at_utc
    FROM ({_KEPT})
    """
)
def import_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below the header, packed: ragged, padded, blank and without id."""
    grid = inputs.customer_grid(spark, sf_dir)
    rows, _ = import_grid(grid, "customer_name", FIELDS, loaded_at=LOADED_AT)
    return _stamp_text(project_fields(rows, FIELDS))


@query(
    f"""
    SELECT entity_id,
           '{{"market":"' || segment || '","No":"' || "No" || '","notes":""}}' AS data
    FROM ({_KEPT})
    """
)
def import_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed JSON text: caller's order and spelling, one field renamed."""
    grid = inputs.customer_grid(spark, sf_dir)
    fields = ["segment", "No", "notes"]
    rows, _ = import_grid(grid, "CUSTOMER_NAME", fields, rename={"segment": "market"})
    return rows.select("entity_id", "data")


@query(
    """
    SELECT o_orderpriority AS entity_id, count(*) AS n, max(CAST(o_orderkey AS VARCHAR)) AS last_key,
           min(len(o_orderstatus)) AS shortest
    FROM orders GROUP BY 1
    """
)
def grid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a raw grid of several files, read back and packed."""
    path = new_path(spark, "grid")
    orders = table(spark, sf_dir, "orders")
    rows = orders.selectExpr(
        "concat_ws(',', o_orderpriority, concat(' \"', o_orderstatus, '\" '), o_orderkey) AS value"
    )
    # Files are read in the order of their names, so the header file comes first.
    spark.range(1).select(
        F.explode(F.array(F.lit("Orders"), F.lit("Priority, STATUS ,key"))).alias("value")
    ).write.text(f"{path}/part=0")
    rows.write.text(f"{path}/part=1")
    parts = [f"{path}/part=0", f"{path}/part=1"]
    packed, _ = import_files(spark, parts, "priority", ["key", "status"])
    return (
        project_fields(packed, ["key", "status"])
        .groupBy("entity_id")
        .agg(
            F.count("*").alias("n"),
            F.max("key").alias("last_key"),
            F.min(F.length(F.replace("status", F.lit('"'), F.lit("")))).cast("long").alias("shortest"),
        )
    )


@query(
    """
    SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
           CAST(o_orderkey AS VARCHAR) AS "order", o_orderpriority AS priority
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders)
    WHERE row_no BETWEEN 3 AND 5000
    """
)
def grid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns and rows of a grid of several files, whose rows go on from file to file."""
    path = new_path(spark, "range")
    orders = table(spark, sf_dir, "orders").repartitionByRange(4, "o_orderkey")
    orders = orders.sortWithinPartitions("o_orderkey")
    columns = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority", "o_orderdate"]
    write_grid(orders.select(*columns), path, include_headers=False)
    grid = read_grid(spark, path, cell_range="B3:F5000")
    names = ["customer", "status", "order", "priority"]
    return grid.select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text
    FROM documents
    """
)
def grid_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks and quotes, written as a grid and read again."""
    path = new_path(spark, "multi-line")
    write_grid(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    grid = read_grid(spark, path, width=3)
    cells = [F.coalesce(F.col("cells")[i], F.lit("")) for i in range(3)]
    rows = grid.select(*[c.alias(n) for c, n in zip(cells, ["doc_id", "lang", "text"], strict=True)])
    return rows.where("doc_id <> 'doc_id'")


_REVISED = f"""
    SELECT entity_id, segment, nation, '2024-01-16 14:20:00' AS loaded_at_utc
    FROM (
        SELECT entity_id, segment, nation FROM ({_KEPT}) WHERE c_custkey % 2 = 1
        UNION ALL
        SELECT entity_id, 'REVISED', nation FROM ({_KEPT}) WHERE c_custkey % 2 = 0
    )
"""


def _two_loads(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The customer grid, and the same later with every other segment revised."""
    grid = inputs.customer_grid(spark, sf_dir)
    first, header = import_grid(grid, "customer_name", FIELDS, loaded_at=LOADED_AT)
    revised = F.when(
        (F.col("row_no") >= 0) & (F.col("row_no") % 2 == 0) & (F.size("cells") > 1),
        F.concat(F.slice("cells", 1, 2), F.array(F.lit("REVISED")), F.slice("cells", 4, 10)),
    ).otherwise(F.col("cells"))
    again = grid.withColumn("cells", revised)
    later = datetime(2024, 1, 16, 14, 20)
    return [first, pack_rows(again, header, "customer_name", FIELDS, loaded_at=later)]


@query(_REVISED)
def history_append_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads appended to a history of files; the latest record of every entity."""
    path = new_path(spark, "history")
    for load in _two_loads(spark, sf_dir):
        append_history_files(load, path)
    return _stamp_text(latest_fields(read_history_files(spark, path), ["segment", "nation"]))


@query(_REVISED)
def history_table_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a history table, made if missing and checked before each load."""
    path = new_path(spark, "history_table")
    for load in _two_loads(spark, sf_dir):
        name = ensure_history(spark, "answergrid", f"h{path[-32:]}", location=path)
        append_history(load, name)
    return _stamp_text(latest_fields(spark.table(name), ["segment", "nation"]))


@query(f"SELECT 'all' AS kind, count(*) AS n FROM ({_KEPT}) UNION ALL SELECT 'revised', count(*) FROM ({_REVISED}) WHERE segment = 'REVISED'")
def history_repeated_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load twice, and one that broke off half-way: one copy of each committed load is read."""
    path = new_path(spark, "loads")
    first, second = _two_loads(spark, sf_dir)
    append_load(first, path, "monday")
    append_load(first, path, "monday")
    write_load(second.where("entity_id < 'M'"), path)
    before = read_loads(spark, path).select(F.lit("all").alias("kind"))
    append_load(second, path, "tuesday")
    revised = project_fields(read_loads(spark, path, ["tuesday"]), ["segment"]).where("segment = 'REVISED'")
    return before.unionByName(revised.select(F.lit("revised").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """
    SELECT DISTINCT ON (user_id) CAST(user_id AS VARCHAR) AS entity_id, event_type AS kind,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS loaded_at_utc
    FROM events ORDER BY user_id, ts DESC, event_id DESC
    """
)
def latest_kept_up_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of events, each merged into the latest records of all users when it comes."""
    history, state = new_path(spark, "loads"), new_path(spark, "latest")
    data = F.to_json(F.struct(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("id"), F.col("event_type").alias("kind")))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), data.alias("data"), F.col("ts").cast("timestamp").alias("loaded_at_utc"), "event_id"
    )
    for number in range(3):
        append_load(events.where(F.col("event_id") % 3 == number), history, f"load {number}")
        refresh_latest(spark, history, state, buckets=16)
    return _stamp_text(project_fields(read_latest(spark, state), ["kind"]))


_PURCHASES = """
    SELECT user_id, ts, arg_max(event_id, event_id) AS purchase_id
    FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts
"""


@query(
    f"""
    SELECT e.event_id, p.purchase_id FROM events e
    ASOF LEFT JOIN ({_PURCHASES}) p ON e.user_id = p.user_id AND e.ts >= p.ts
    """
)
def events_as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last purchase its user had made by then."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'")
    found = as_of(events, bought, key="user_id", at="ts", history_key="user_id", order="ts", tie="event_id", record="purchase")
    return found.select("event_id", F.col("purchase.event_id").alias("purchase_id"))


@query(
    f"""
    SELECT purchase_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from,
           strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), '%Y-%m-%d %H:%M:%S') AS valid_until
    FROM ({_PURCHASES})
    """
)
def validity_of_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when until when each purchase was its user's last one."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    spans = validity(bought, "user_id", "ts", "event_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spans.select(F.col("event_id").alias("purchase_id"), text("valid_from"), text("valid_until"))


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderpriority AS priority,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS placed, '' AS reviewed
    FROM orders
    """
)
def export_then_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields written as a grid of many files, then imported again."""
    orders = documents_of(spark, sf_dir, "orders")
    df = orders.select("o_orderkey", "o_orderdate", inputs.order_json().alias("answers"))
    wide = fields_as_columns(df, "answers", ["Priority"]).drop("answers")
    path = new_path(spark, "round-trip")
    write_grid(wide, path, row_limit=None)
    rows, _ = import_files(
        spark,
        path,
        "o_orderkey",
        ["priority", "o_orderdate", "reviewed"],
        rename={"o_orderdate": "placed"},
        repeated_headers=True,
    )
    return project_fields(rows, ["priority", "placed", "reviewed"]).drop("loaded_at_utc")


_LATEST_EVENT = """
    SELECT DISTINCT ON (user_id) user_id, event_id, event_type,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen
    FROM events ORDER BY user_id, ts DESC, event_id DESC
"""


def _latest_events(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    latest = latest_per_entity(events, "user_id", "ts", "event_id", method)
    return latest.select(
        "user_id", "event_id", "event_type",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"),
    )


@query(_LATEST_EVENT)
def latest_per_entity_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of every user, by ranking."""
    return _latest_events(spark, sf_dir, "window")


@query(_LATEST_EVENT)
def latest_per_entity_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while grouping."""
    return _latest_events(spark, sf_dir, "aggregate")


@query(
    """
    SELECT DISTINCT ON (user_id) user_id, json_extract_string(props, '$.k') AS k
    FROM events ORDER BY user_id, ts DESC, event_id DESC
    """
)
def latest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the latest document of every user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "props")
    latest = latest_per_entity(events, "user_id", "ts", "event_id")
    return project_fields(latest, ["k"], "props").select("user_id", "k")


@query(
    """
    SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS "user", '' AS none
    FROM events
    """
)
def stream_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field extraction over a stream of files, appended to files."""
    schema = table(spark, sf_dir, "events").schema
    events = stream_files(spark, sf_dir, schema, name_filter="events.parquet")
    answers = inputs.list_of(
        inputs.item(title="Kind", value=F.col("event_type")),
        inputs.item(question="User", response=F.col("user_id")),
    )
    wide = fields_as_columns(
        events.select("event_id", answers.alias("answers")), "answers", ["kind", "user", "none"]
    ).drop("answers")
    path = new_path(spark, "stream-fields")
    append_stream(wide, path, path.rsplit("/", 1)[-1]).awaitTermination()
    return spark.read.parquet(path)


@query(
    """
    SELECT c_name AS entity_id, c_mktsegment AS segment, '2024-01-15 10:30:00' AS loaded_at_utc
    FROM customer WHERE c_custkey % 5 <> 0
    """
)
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing over a stream of rows, appended to a history."""
    schema = table(spark, sf_dir, "customer").schema
    customers = stream_files(spark, sf_dir, schema, name_filter="customer.parquet")
    cells = customers.select(
        F.array(F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), F.col("c_mktsegment")).alias("cells")
    )
    header = known_header({"name": 0, "segment": 1})
    rows = pack_rows(cells, header, "name", ["segment"], loaded_at=LOADED_AT)
    path = new_path(spark, "stream-history")
    append_stream(rows, path, path.rsplit("/", 1)[-1]).awaitTermination()
    return _stamp_text(project_fields(read_history_files(spark, path), ["segment"]))


@query(
    """
    SELECT count(*) AS rows_written, count(*) FILTER (c_custkey % 3 = 0) AS empty_segment,
           'notes' AS missing_fields
    FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0
    """
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers observed while an import writes its rows."""
    grid = inputs.customer_grid(spark, sf_dir)
    rows, header = import_grid(grid, "customer_name", FIELDS)
    run = Run("import")
    watched = run.watch(project_fields(rows, FIELDS), ["segment"])
    watched.write.parquet(new_path(spark, "watched"))
    numbers = run.report(header)
    return spark.range(1).select(
        F.lit(numbers["rows"]).cast("long").alias("rows_written"),
        F.lit(numbers["empty_segment"]).cast("long").alias("empty_segment"),
        F.lit(",".join(numbers["missing_fields"])).alias("missing_fields"),
    )
