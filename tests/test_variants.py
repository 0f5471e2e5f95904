"""Documents by the batch: every kind of value, all widths of offsets, one pass."""

import json
import random

from pyspark.sql import functions as F

from answergrid import profile_all_paths
from answergrid.functions import documents, variants

NUMBERS = [
    "0", "-1", "127", "-128", "128", "-32769", "2147483648", "-9223372036854775808", "9223372036854775807",
    "12345678901234567890", "9007199254740993", "9007199254740993.5", "0.1", "-2.675", "1.7976931348623157", "123456.789012345",
    "0.00000000000000000000000000012", "12345678901234567890.12345678901234567", "-99999999999999999999999999999999999999",
    "1e5", "1.5e-7", "5e-324", "1e400", "123456789012345678901234567890123456789012345", "0.30000000000000004",
]


def as_spark_says(df):
    """The same counts, by Spark's own functions, of documents that are objects of plain values."""
    node = F.col("e.value")
    kind = documents.kind(node)
    rows = df.select(documents.document_of(df, "j").alias("doc")).where("doc IS NOT NULL").select(F.explode(documents.object_map(F.col("doc"))).alias("key", "value"))
    rows = rows.select(F.struct("key", "value").alias("e")).select(
        F.concat(F.lit("$."), "e.key").alias("path"),
        kind.alias("kind"),
        F.when(kind.isin("string", "boolean"), node.cast("string")).alias("text"),
        F.when(kind == "number", F.try_variant_get(node, "$", "double")).alias("number"),
    )
    return rows.groupBy("path", "kind").agg(F.count("*"), F.min("text"), F.max("text"), F.min("number"), F.max("number"))


def same(df):
    got = {tuple(map(str, r)) for r in profile_all_paths(df, "j").where("path <> '$'").collect()}
    assert got and got == {tuple(map(str, r)) for r in as_spark_says(df).collect()}


def test_numbers_and_texts(spark):
    rng = random.Random(2)
    texts = ["", "a", "é", "😀", "x" * 63, "x" * 64, "y" * 70_000, "\\", "\x7f"]
    docs = [f'{{"n": {n}, "n{i}": {n}, "m{i % 5}": {n}}}' for i, n in enumerate(NUMBERS)]
    docs += [json.dumps({"t": t, f"t{i}": t, "b": i % 3 == 0, "none": None}) for i, t in enumerate(texts)]
    docs += [json.dumps({f"key {rng.randint(0, 400)}": "z" * rng.randint(0, 900) for _ in range(n)}) for n in (1, 255, 256, 300)]
    docs += ['{"a": 1, "a": "twice"}', '{"a": 1} and more', "{", "", None]
    df = spark.createDataFrame([(d,) for d in docs], "j STRING")
    same(df)
    same(df.repartition(7))


def test_typed_columns(spark):
    df = spark.sql("""
        SELECT struct(a, a AS again) AS j FROM VALUES (CAST('NaN' AS DOUBLE)), (1.5D), (CAST('-Infinity' AS DOUBLE)), (NULL) AS t(a)
    """)
    same(df)
    same(spark.sql("""
        SELECT named_struct('f', CAST(id / 3 AS FLOAT), 'd', CAST(id * 7.25 AS DECIMAL(38, 10)), 's', CAST(id AS SMALLINT), 'day', DATE'2024-01-01',
            'at', TIMESTAMP'2024-01-01 00:00:00', 'ntz', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'bytes', X'00ff', 'on', id = 1, 'x', CAST(id AS STRING)) AS j
        FROM range(5)
    """))


def test_documents_longer_than_a_slice(spark):
    docs = [json.dumps({"k": ["x" * 1000] * n, "n": n}) for n in (1, 3, 0, 2, 5)]
    df = spark.createDataFrame([(d,) for d in [*docs, None]], "j STRING")
    parsed = df.coalesce(1).select(F.parse_json("j").alias("j")).mapInArrow(
        lambda batches: (b for batch in batches for some in variants.slices(batch.column(0), 2500) for b in [variants._counted(variants.Documents(some))]),
        variants.COUNTED,
    )
    assert parsed.where("path = '$'").agg(F.count("*"), F.sum("n_rows")).collect() == [(4, 5)]
    got = {r["path"]: r["n_rows"] for r in profile_all_paths(df, "j").collect()}
    assert got == {"$": 5, "$.k": 5, "$.k[*]": 11, "$.n": 5}


def test_deep_documents_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    deep = json.dumps({"a": {"b": [{"c": [{"size": {"quantity": 1}}]}]}})

    @F.udf("string")
    def made(i):
        read.add(1)
        return deep

    df = spark.range(0, 20, 1, 2).select(made.asNondeterministic()("id").alias("j"))
    got = {r["path"]: r["n_rows"] for r in profile_all_paths(df, "j").collect()}
    assert got["$.a.b[*].c[*].size.quantity"] == 20
    assert read.value == 20
