"""Values as the text of a grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space around a cell.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """``col`` without white space of any kind at both ends."""
    return F.trim(col, F.lit(WHITE_SPACE))


def _iso_time(col: Column, offset: Column) -> Column:
    """ISO-8601 with six fraction digits, or none when the fraction is zero."""
    text = col.cast("string")
    seconds = F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T"))
    fraction = F.when(F.length(text) > 19, F.rpad(F.substring(text, 20, 7), 7, "0"))
    return F.concat(seconds, F.coalesce(fraction, F.lit("")), offset)


def _float_text(col: Column) -> Column:
    """Shortest text of a double; plain from 1e-4 up to 1e16, else with exponent.

    Spark's own text differs only where it uses an exponent, or names a value
    that is no number, so almost all values take the short way.
    """
    text = col.cast("string")
    digits = F.regexp_replace(col.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(text, r"(\.0)?E(-?)", "e$2")
    power = F.regexp_replace(power, r"e(\d)", "e+$1")
    power = F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")
    plain = (F.abs(col) >= 1e-4) & (F.abs(col) < 1e16)
    return F.when(F.contains(text, F.lit("E")), F.when(plain, digits).otherwise(power)).otherwise(
        F.lower(F.replace(text, F.lit("Infinity"), F.lit("inf")))
    )


def to_text(col: Column, dtype: T.DataType) -> Column:
    """A value of any type as cell text; NULL is an empty cell."""
    if isinstance(dtype, T.StringType):
        text = col
    elif isinstance(dtype, T.TimestampNTZType):
        text = _iso_time(col, F.lit("+00:00"))
    elif isinstance(dtype, T.TimestampType):
        text = _iso_time(col, F.date_format(col, "xxx"))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(col, F.lit("True")).when(~col, F.lit("False"))
    elif isinstance(dtype, T.DoubleType):
        text = _float_text(col)
    elif isinstance(dtype, T.FloatType):
        text = _float_text(col.cast("string").cast("double"))
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(col)
    elif isinstance(dtype, T.BinaryType):
        text = F.base64(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


def places(df: DataFrame) -> list[str]:
    """A plain name per column, by place: names may repeat or hold dots."""
    return [f"__{i}" for i in range(len(df.columns))]


def all_text(df: DataFrame) -> list[Column]:
    """Every column of ``df.toDF(*places(df))`` as cell text, under its name in ``df``."""
    return [to_text(F.col(p), f.dataType).alias(f.name) for p, f in zip(places(df), df.schema, strict=True)]
