"""Cell text, caps and trends."""

import math
import random
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from answergrid import as_text, capped, header_of, missing_by_day


def test_cell_text(spark):
    df = spark.createDataFrame(
        [
            (
                1, 2.5, True, "t", Decimal("1.50"), date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5),
                datetime(2024, 1, 2, 3, 4, 5, 120000), {"k": [1]}, ["a"],
            ),
            (None,) * 10,
        ],
        "i INT, d DOUBLE, b BOOLEAN, s STRING, c DECIMAL(9,2), day DATE, ts TIMESTAMP,"
        " local TIMESTAMP_NTZ, m MAP<STRING,ARRAY<INT>>, a ARRAY<STRING>",
    )
    rows = as_text(df).collect()
    assert tuple(rows[0]) == (
        "1", "2.5", "True", "t", "1.50", "2024-01-02", "2024-01-02T03:04:05+00:00",
        "2024-01-02T03:04:05.120000+00:00", '{"k":[1]}', '["a"]',
    )
    assert tuple(rows[1]) == ("",) * 10
    assert header_of(df) == df.columns


def test_time_zone_offset(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 12),)], "ts TIMESTAMP")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert as_text(df).first()[0].endswith("T08:00:00-04:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_double_text(spark):
    r = random.Random(3)
    values = [0.0, -0.0, 1.0, 1e7, 12345678.9, 1e15, 1e16, 1e20, 1.5e-7, 1e-4, 1e-5, -0.0005,
              0.00012345678901234567, 1.5e300, -1.25e-10, math.inf, -math.inf, math.nan]
    values += [r.uniform(-1, 1) * 10 ** r.randint(-4, 16) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in as_text(df).collect()]
    assert [(v, g) for v, g in zip(values, got) if str(v) != g] == []
    floats = spark.createDataFrame([(1.1,), (1e10,)], "v FLOAT")
    assert [r[0] for r in as_text(floats).collect()] == ["1.1", "10000000000.0"]


def test_cap(spark):
    df = spark.range(100)
    assert capped(df, 7).count() == 7
    assert capped(df).count() == 100
    assert capped(df, None).count() == 100
    assert [r["id"] for r in capped(df, 3, order=[F.col("id").desc()]).collect()] == [99, 98, 97]
    assert [r["id"] for r in capped(df, None, order=[F.col("id").desc()]).take(2)] == [99, 98]
    many = spark.range(0, 1_000_000, 1, 1000)
    assert capped(many, 70).distinct().count() == 70
    assert capped(many.where("id >= 999990"), 70).count() == 10
    top = capped(many, 5, order=[F.col("id").desc()])
    assert [r["id"] for r in top.collect()] == [999_999 - i for i in range(5)]


def test_no_limit_is_whole(spark):
    many = spark.range(0, 120_000, 1, 8)
    assert capped(many).count() == 120_000


def test_text_of_repeated_and_dotted_names(spark):
    both = spark.sql("SELECT 1 AS `a.b`, 'x' AS c, 'x' AS c")
    assert [tuple(r) for r in as_text(both).collect()] == [("1", "x", "x")]
    assert as_text(both).columns == ["a.b", "c", "c"]


def test_trend(spark):
    days = [(datetime(2024, 1, d, h), e) for d in range(1, 11) for h, e in ((1, ""), (2, "x"), (3, None))]
    df = spark.createDataFrame(days, "at TIMESTAMP, email STRING")
    rows = missing_by_day(df, "at", "email", as_of=datetime(2024, 1, 10, 2, 30)).collect()
    assert [tuple(r) for r in rows] == [
        *[(date(2024, 1, d), 3, 1) for d in range(10, 3, -1)], (date(2024, 1, 3), 1, 0),
    ]
    recent = df.withColumn("at", F.current_timestamp())
    assert missing_by_day(recent, "at", "email").first()["total_responses"] == 30
