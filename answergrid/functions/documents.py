"""JSON documents as columns: parse once, then read typed parts.

A document is held as ``VARIANT``.  Parts are read with one typed
``try_variant_get`` per document, for example a whole array of records in a
single cast.  An element that is not an object becomes NULL in that cast, and
the rest of the array is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "$"


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options that this package relies on.

    A repeated key keeps its last value instead of making the document
    unreadable.  Generated methods stay small enough for the JVM to compile,
    which matters for wide tables; larger ones are split by Spark.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def document(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """``col`` as a VARIANT document; text that is not JSON becomes NULL."""
    column = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.VariantType):
        return column
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_variant_object(column)
    return F.try_parse_json(column)


def document_of(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df`` as a document, whatever its type."""
    configure(df.sparkSession)
    return document(name, df.select(name).schema[0].dataType)


def _collide(keys: Sequence[str]) -> bool:
    return len({k.lower() for k in keys}) < len(keys)


def record_type(keys: Iterable[str]) -> str:
    """The type that reads ``keys`` of an object as text.

    A struct converts only the wanted keys.  Keys that differ only in case
    cannot share a struct, so those are read through a map.
    """
    unique = list(dict.fromkeys(keys))
    if _collide(unique):
        return "map<string,string>"
    quoted = ("`{}`:string".format(k.replace("`", "``")) for k in unique)
    return f"struct<{','.join(quoted)}>"


def records(doc: Column, path: str, keys: Iterable[str]) -> Column:
    """The array at ``path`` as records of ``keys``; NULL if it is no array."""
    return F.try_variant_get(doc, path, f"array<{record_type(keys)}>")


def root_records(doc: Column, keys: Iterable[str]) -> Column:
    """The root array as records, or the root object as the only record."""
    keys = list(keys)
    single = F.try_variant_get(doc, ROOT, record_type(keys))
    return F.coalesce(records(doc, ROOT, keys), F.array_compact(F.array(single)))


def item_records(doc: Column, keys: Iterable[str], path: str | None = None) -> Column:
    """The items of a document.

    With ``path``, the array there.  Otherwise ``$.list`` if that is an array,
    else the root array, else the root object as the only item.
    """
    keys = list(keys)
    if path is not None:
        return records(doc, path, keys)
    return F.coalesce(records(doc, "$.list", keys), root_records(doc, keys))


def pluck(items: Column, key: str, keys: Iterable[str]) -> Column:
    """The texts of one key over an array of records read with ``keys``."""
    if _collide(list(dict.fromkeys(keys))):
        return F.transform(items, lambda e: e[key])
    return items[key]


def object_map(doc: Column, path: str = ROOT, value_type: str = "variant") -> Column:
    """The object at ``path`` as a map; NULL if it is no object."""
    return F.try_variant_get(doc, path, f"map<string,{value_type}>")


def field_text(doc: Column, key: str, path: str = ROOT) -> Column:
    """The text under ``key`` of the object at ``path``, for any spelling."""
    for quote in "'\"":
        if quote not in key:
            return F.try_variant_get(doc, f"{path}[{quote}{key}{quote}]", "string")
    return F.element_at(object_map(doc, path, "string"), F.lit(key))


def kind(doc: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``.

    Documents made from typed columns may also hold kinds such as ``date``.
    """
    outer = F.regexp_extract(F.schema_of_variant(doc), "^[A-Z_]+", 0)
    return (
        F.when(outer.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit("number"))
        .when(outer == "VOID", F.lit("null"))
        .otherwise(F.lower(outer))
    )
