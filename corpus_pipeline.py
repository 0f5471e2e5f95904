"""Training text from raw documents: five stages, each of which reads what the one before wrote.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergrid.llm.batches import stored
from answergrid.llm.decontaminate import decontaminate
from answergrid.llm.language_id import UNKNOWN, identify, learn
from answergrid.llm.line_dedup import drop_common_lines
from answergrid.llm.mixing import mix_sources
from answergrid.llm.near_dedup import drop_near_duplicates
from answergrid.llm.registry import table
from answergrid.llm.ship import ship

#: Lines in so many documents go.
LINE_DOCS = 10
#: A document must have at least this part of its n-grams in its language.
LEAST_KNOWN = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects text without letters and text that is in none of the languages of the corpus."""
    ship(spark)
    found = identify(docs, learn(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= LEAST_KNOWN)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; ``n_chars`` follows the text, and no document goes."""
    ship(spark)
    kept = drop_common_lines(docs, LINE_DOCS).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id."""
    ship(spark)
    return drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold ten words in a row of a benchmark item."""
    ship(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until every source has the same weight, in a random order."""
    ship(spark)
    return mix_sources(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", leaks),
    ("mixing", mix),
]

#: The stages count n-grams, samples and suffixes, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
