"""What the plans must look like to hold at any size."""

import re

from pyspark.sql import functions as F

from answergrid import (
    fields_as_columns,
    latest_per_entity,
    pack_rows,
    profile_json,
    unnest_pivot,
    unnest_positional,
    unnest_rows,
)
from answergrid.functions import strategies
from answergrid.operators.ingest import Header
from answergrid.plans import QUERIES
from answergrid.plans.registry import table


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def test_one_parse_and_no_shuffle_per_document(spark, sf_dir):
    for titles in (["k"], [f"title {i}" for i in range(30)]):
        df = fields_as_columns(events(spark, sf_dir), "props", titles).drop("props")
        plan = physical(df)
        assert plan.count("parseJson(") == 1
        assert "Exchange" not in plan
        assert "Python" not in plan
    every = [*strategies.default_strategies(), strategies.direct_field(), strategies.positional(),
             strategies.exact_title()]
    plan = physical(fields_as_columns(events(spark, sf_dir), "props", ["k", "a%"], strategies=every))
    assert plan.count("parseJson(") == 1


def test_one_parse_with_a_filter_on_a_new_column(spark, sf_dir):
    df = fields_as_columns(events(spark, sf_dir), "props", ["k", "other"])
    plan = physical(df.where("k <> '' and other like 'a%'").drop("props"))
    assert plan.count("parseJson(") == 1
    assert "Exchange" not in plan
    plan = physical(QUERIES["sql_json_fields"].run(spark, sf_dir))
    assert plan.count("parseJson(") == 1


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    df = fields_as_columns(events(spark, sf_dir), "props", ["k"]).where("user_id = 3").select("k")
    plan = physical(df)
    assert re.search(r"PushedFilters: \[IsNotNull\(user_id\), EqualTo\(user_id,3\)\]", plan)
    assert "ReadSchema: struct<user_id:bigint,props:string>" in plan


def test_unused_fields_are_not_extracted(spark, sf_dir):
    df = fields_as_columns(events(spark, sf_dir), "props", ["k", "unused title"]).select("k")
    assert "unused" not in physical(df)


def test_row_local_operators_do_not_shuffle(spark, sf_dir):
    df = events(spark, sf_dir)
    header = Header(0, {"id": 0})
    grid = df.select(F.col("event_id").alias("row_no"), F.array("event_type").alias("cells"))
    for result in (
        unnest_rows(df, "props", "$.x"),
        unnest_positional(df, "props", "a", "b", 3),
        unnest_pivot(df, "props", "a", "b", ["x", "y"]),
        pack_rows(grid, header, "id", ["id"]),
    ):
        plan = physical(result)
        assert "Exchange" not in plan and "Python" not in plan


def test_latest_reduces_before_its_only_shuffle(spark, sf_dir):
    df = events(spark, sf_dir)
    plan = physical(latest_per_entity(df, "user_id", "ts", "event_id"))
    assert plan.count("Exchange") == 1
    before = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before and "Partial" in before
    plan = physical(latest_per_entity(df, "user_id", "ts", "event_id", "aggregate"))
    assert plan.count("Exchange") == 1
    assert "partial_max_by" in plan[plan.index("Exchange"):]


def test_profile_counts_before_its_shuffle(spark, sf_dir):
    plan = physical(profile_json(events(spark, sf_dir), "props"))
    assert plan.count("Exchange") == 1
    assert "partial_count" in plan[plan.index("Exchange"):]


def test_one_hot_entity(spark):
    """A third of the rows in one entity: right, and reduced before the shuffle."""
    rows = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("entity_id"),
        F.col("id").alias("loaded_at_utc"),
        F.col("id").cast("string").alias("data"),
    )
    expected = {r[0]: r[1] for r in rows.groupBy("entity_id").agg(F.max("loaded_at_utc")).collect()}
    for method in ("window", "aggregate"):
        got = latest_per_entity(rows, method=method).collect()
        assert {r["entity_id"]: r["loaded_at_utc"] for r in got} == expected
