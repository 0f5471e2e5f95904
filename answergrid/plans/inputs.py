"""JSON documents and cell grids made from the rows of the test tables.

Every document is made from one row, so making them needs no shuffle and no
document grows with the data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergrid.functions.names import free_names
from answergrid.plans.registry import documents_of, table


def item(**values: Column | str) -> Column:
    """A JSON object of the given keys; text arguments are literal texts."""
    fields = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()]
    return F.to_json(F.struct(*fields))


def text_of(col: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(col))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def array_of(*items: Column) -> Column:
    """A JSON array; NULL items are left out."""
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def object_of(**parts: Column) -> Column:
    """A JSON object of JSON texts; NULL parts are left out."""
    named = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def list_of(*items: Column) -> Column:
    """The ``{"list": [...]}`` shape."""
    return object_of(list=array_of(*items))


def records_json(*records: dict[str, Column | str]) -> Column:
    """``{"list": [...]}`` of records with differing keys, in one conversion."""
    keys = dict.fromkeys(k for r in records for k in r)

    def value(record: dict[str, Column | str], key: str) -> Column:
        found = record.get(key)
        return (found if isinstance(found, Column) else F.lit(found)).alias(key)

    rows = [F.struct(*[value(r, k) for k in keys]) for r in records]
    return F.to_json(F.struct(F.array(*rows).alias("list")))


def order_json() -> Column:
    """An order as a survey answer, with differing title and value keys."""
    return records_json(
        {"question_title": "Order status", "value_text": F.col("o_orderstatus")},
        {"title": "Order priority", "answer": F.col("o_orderpriority")},
        {"question": "Customer number", "text": F.col("o_custkey").cast("string")},
        {"name": "Order date", "value": F.date_format("o_orderdate", "yyyy-MM-dd")},
        {"name": "Order number", "response": F.col("o_orderkey")},
    )


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, answers)``: every order as a survey answer."""
    orders = documents_of(spark, sf_dir, "orders")
    return orders.select("o_orderkey", order_json().alias("answers"))


def turn_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, answers)``: every conversation turn with its whole text."""
    turns = documents_of(spark, sf_dir, "conversations")
    answers = records_json(
        {"question_title": "Speaker role", "value_text": F.col("role")},
        {"question": "Position in the conversation", "response": F.col("turn")},
        {"title": "Message text", "answer": F.col("text")},
    )
    return turns.select("conv_id", "turn", answers.alias("answers"))


def _value_end(col: Column, dtype: T.DataType) -> Column:
    """The end of a record, after its title: the value as text, if there is one."""
    text = col.cast("string")
    # Numbers and times have no character that JSON writes in another way.
    plain = isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    quoted = F.concat(F.lit('"'), text, F.lit('"')) if plain else text_of(text)
    return F.when(col.isNull(), "}").otherwise(F.concat(F.lit(',"value_text":'), quoted, F.lit("}")))


def lineitem_answers(spark: SparkSession, sf_dir: str, repeats: int = 1) -> DataFrame:
    """``(l_orderkey, l_linenumber, answers)``: eleven records per line item and repeat."""
    lines = documents_of(spark, sf_dir, "lineitem")
    # Every text is made once, however often it is repeated.
    ends, parts = free_names(["l_orderkey", "l_linenumber"], *lines.columns), []
    for r in range(repeats):
        for c, end in zip(lines.columns, ends, strict=True):
            title = json.dumps({"question_title": f"Line {c[2:]} {r}"}, separators=(",", ":"))
            parts += [F.lit("," * bool(parts) + title[:-1]), F.col(end)]
    made = [_value_end(F.col(f.name), f.dataType).alias(end) for f, end in zip(lines.schema, ends, strict=True)]
    answers = F.concat(F.lit('{"list":['), *parts, F.lit("]}"))
    return lines.select("l_orderkey", "l_linenumber", *made).select("l_orderkey", "l_linenumber", answers.alias("answers"))


def lineitem_titles(spark: SparkSession, sf_dir: str, repeats: int = 1) -> list[str]:
    columns = table(spark, sf_dir, "lineitem").columns
    return [f"line {c[2:]} {r}" for r in range(repeats) for c in columns]


def customer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_no, cells)``: title rows, a header, then one ragged row per customer.

    Every third row lacks its last cell, every fifth has a blank id, every
    seventh is blank; cells are padded with white space of several kinds.
    """
    key = F.col("c_custkey")
    cells = (
        F.when(key % 7 == 0, F.array(F.lit(""), F.lit(" \t")))
        .when(
            key % 3 == 0,
            F.array(key.cast("string"), F.when(key % 5 == 0, F.lit(" ")).otherwise(F.col("c_name"))),
        )
        .otherwise(
            F.array(
                key.cast("string"),
                F.when(key % 5 == 0, F.lit(" ")).otherwise(
                    F.concat(F.lit(" \t"), F.col("c_name"), F.lit(" \n"))
                ),
                F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")),
                F.col("c_nationkey").cast("string"),
            )
        )
    )
    rows = table(spark, sf_dir, "customer").select(key.alias("row_no"), cells.alias("cells"))
    above = spark.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(-3).cast("long"), F.array(F.lit("All customers"))),
                F.struct(F.lit(-2).cast("long"), F.array().cast("array<string>")),
                F.struct(
                    F.lit(-1).cast("long"),
                    F.array(*map(F.lit, ["No", " Customer_Name ", "SEGMENT", "nation", "segment"])),
                ),
            )
        ).alias("row_no", "cells")
    )
    return above.unionByName(rows)
