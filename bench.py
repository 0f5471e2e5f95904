"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of cores (default 8).  Every query runs to the end into the ``noop``
sink, so all columns of all rows are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from answergrid.functions import configure
from answergrid.operators import fields_as_columns
from answergrid.plans import QUERIES, inputs
from answergrid.plans.registry import table
from answergrid.sources import import_files, new_path, write_grid

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "fields_as_columns_turns",
    "fields_as_columns_orders",
    "fields_as_columns_lineitem",
    "strategy_precedence",
    "titles_in_other_scripts",
    "direct_field",
    "exact_title",
    "multi_column",
    "sql_json_field",
    "sql_field_table",
    "events_as_of_purchase",
    "unnest_text_rows",
    "unnest_positional_three",
    "unnest_pivot_found",
    "profile_mixed_shapes",
    "import_pack",
    "latest_per_entity_ranked",
    "latest_per_entity_grouped",
    "export_text",
    "join_filter_agg",
    "group_by_day",
    "distinct_on",
]


def stored_fields(path: str, titles: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """So many titles from stored documents of 33 records."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fields_as_columns(spark.read.parquet(path), "answers", titles).drop("answers")

    return run


def export_lines(path: str) -> Callable[[SparkSession, str], None]:
    """Every line item as text, written to grid files."""

    def run(spark: SparkSession, sf_dir: str) -> None:
        lines = table(spark, sf_dir, "lineitem")
        write_grid(lines, path, row_limit=None, include_headers=False)

    return run


def import_lines(path: str) -> Callable[[SparkSession, str], DataFrame]:
    """A raw grid of line items: find the header, pack every row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fields = table(spark, sf_dir, "lineitem").columns
        parts = [f"{path}/a-header", f"{path}/b-rows"]
        return import_files(spark, parts, "l_orderkey", fields[1:], width=len(fields))[0]

    return run


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("answergrid-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    runs = {name: QUERIES[name].run for name in HEADLINES}
    # Documents of 33 records, about 2 KB each, stored once and not timed.
    stored = new_path(spark, "bench-documents")
    inputs.lineitem_answers(spark, SF_DIR, 3).write.parquet(stored)
    titles = inputs.lineitem_titles(spark, SF_DIR, 3)
    for n in (3, 10, 30):
        runs[f"fields_{n}_of_33"] = stored_fields(stored, titles[:n])

    grid = new_path(spark, "bench-grid")
    header = ",".join(table(spark, SF_DIR, "lineitem").columns)
    spark.range(1).selectExpr(f"'{header}' AS value").write.text(f"{grid}/a-header")
    runs["export_lineitem_grid"] = export_lines(f"{grid}/b-rows")
    runs["import_lineitem_grid"] = import_lines(grid)

    def finish(df: DataFrame | None) -> None:
        if df is not None:
            df.write.format("noop").mode("overwrite").save()

    # One warm-up, so that the first query does not pay for starting the JVM.
    finish(runs["direct_field"](spark, SF_DIR))
    seconds = {}
    for name, run in runs.items():
        started = time.perf_counter()
        finish(run(spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - started, 3)

    rows = {
        name: spark.read.parquet(f"{SF_DIR}/{name}.parquet").count()
        for name in ("orders", "lineitem")
    }
    per_second = {
        "export_text": rows["orders"] / seconds["export_text"],
        "export_lineitem_grid": rows["lineitem"] / seconds["export_lineitem_grid"],
        "import_lineitem_grid": rows["lineitem"] / seconds["import_lineitem_grid"],
        "fields_as_columns_orders": rows["orders"] / seconds["fields_as_columns_orders"],
        "fields_as_columns_lineitem": rows["lineitem"] / seconds["fields_as_columns_lineitem"],
        "fields_3_of_33": rows["lineitem"] / seconds["fields_3_of_33"],
        "fields_10_of_33": rows["lineitem"] / seconds["fields_10_of_33"],
        "fields_30_of_33": rows["lineitem"] / seconds["fields_30_of_33"],
    }
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows_per_sec": {k: round(v) for k, v in per_second.items()},
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
