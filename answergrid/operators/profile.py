"""What a JSON column contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergrid.functions import documents, variants
from answergrid.sources.shared import new_path

# Beginnings of question titles, and the length over which a text may
# be a title.
TITLE_PREFIXES = ("С ", "Ваш", "Как", "Что")
TITLE_LENGTH = 10

_NODE = "array<struct<path:string,node:variant>>"


def _entries(doc: Column, prefix: str) -> Column:
    """The keys of an object with their values."""
    return F.transform(
        F.map_entries(documents.object_map(doc)),
        lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("path"), e["value"].alias("node")),
    )


def _nodes(doc: Column, path: str) -> Column:
    """The part at ``path``, its elements or keys, and its elements' keys."""
    empty = F.array().cast(_NODE)
    part = doc if path == documents.ROOT else F.try_variant_get(doc, path, "variant")
    elements = F.try_variant_get(doc, path, "array<variant>")
    return F.concat(
        F.array(F.struct(F.lit(path).alias("path"), part.alias("node"))),
        F.coalesce(_entries(part, f"{path}."), empty),
        F.coalesce(
            F.transform(
                elements,
                lambda e: F.struct(F.lit(f"{path}[*]").alias("path"), e.alias("node")),
            ),
            empty,
        ),
        F.coalesce(
            F.flatten(
                F.transform(elements, lambda e: F.coalesce(_entries(e, f"{path}[*]."), empty))
            ),
            empty,
        ),
    )


def _exploded(df: DataFrame, col: str, path: str) -> DataFrame:
    parsed = df.select(documents.document_of(df, col).alias("doc"))
    return (
        parsed.select(F.explode(_nodes(F.col("doc"), path)).alias("n"))
        .select("n.path", "n.node")
        .where("node IS NOT NULL")
    )


def profile_json(
    df: DataFrame, col: str, path: str = documents.ROOT, sample_length: int | None = None
) -> DataFrame:
    """``(path, kind, n_rows, sample)`` of a column, over all its rows.

    Describes the root, the keys of an object or the elements of an array, and
    the keys of those elements.  ``n_rows`` counts the values met; ``sample``
    is the least of the plain values, or of those with at most ``sample_length``
    characters.  Start deeper with ``path``.
    Values are counted before the shuffle, so a common path moves few rows.
    """
    kinds = _exploded(df, col, path).withColumn("kind", documents.kind(F.col("node")))
    # Only plain values become text: a nested one could be a whole document.
    plain = F.col("kind").isin("string", "number", "boolean")
    texts = kinds.select("path", "kind", F.when(plain, F.col("node").cast("string")).alias("text"))
    shown = F.col("text")
    if sample_length is not None:
        shown = F.when(F.length("text") <= sample_length, shown)
    return texts.groupBy("path", "kind").agg(
        F.count("*").alias("n_rows"),
        F.min(shown).alias("sample"),
    )


def profile_all_paths(df: DataFrame, col: str, depth: int = 4) -> DataFrame:
    """Every path of a column's documents, however deep.

    ``(path, kind, n_rows, least, greatest, least_number, greatest_number)``: ``$.a[*].b`` is
    the key ``b`` of the elements of ``a``; ``n_rows`` counts the values met there, and the
    least and greatest are those of texts and booleans, and of numbers.

    All levels are walked in one pass, a few megabytes of documents at once, and each such
    part gives one row per path and kind, so a common path moves few rows.  What is counted
    is written, as small as the number of paths.  ``depth`` counts no more: it was the number
    of levels of a first pass.
    """
    docs = df.select(documents.document_of(df, col).alias("doc"))
    # A missing document has no root; JSON null is a value of kind null.
    counted = docs.mapInArrow(variants.count_paths, variants.COUNTED).groupBy("path", "kind").agg(
        F.sum("n_rows").alias("n_rows"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.min("least_number").alias("least_number"),
        F.max("greatest_number").alias("greatest_number"),
    )
    path = new_path(df.sparkSession, "paths")
    counted.write.parquet(path)
    return df.sparkSession.read.schema(counted.schema).parquet(path)


def json_schema(df: DataFrame, col: str) -> DataFrame:
    """One row with the common schema of the whole column."""
    doc = documents.document_of(df, col)
    return df.agg(F.schema_of_variant_agg(doc).alias("json_schema"))


def candidate_titles(
    df: DataFrame,
    col: str,
    prefixes: Sequence[str] = TITLE_PREFIXES,
    min_len: int = TITLE_LENGTH,
    path: str = documents.ROOT,
) -> DataFrame:
    """``(key_path, title, n)``: texts of the items that look like titles.

    A text does if it starts with one of ``prefixes`` or is longer than
    ``min_len``.
    """
    title = F.col("node").cast("string")
    looks = F.length("title") > min_len
    for prefix in prefixes:
        looks = looks | F.startswith("title", F.lit(prefix))
    return (
        _exploded(df, col, path)
        .where(F.col("path").startswith(f"{path}[*].") & (documents.kind(F.col("node")) == "string"))
        .select(F.col("path").alias("key_path"), title.alias("title"))
        .where(looks)
        .groupBy("key_path", "title")
        .agg(F.count("*").alias("n"))
    )
