"""A history that survives repeated and broken loads, and its latest records kept up to date.

A load is written to a folder of its own and counts only once a row in the manifest names
it.  A load that breaks off has no row, so nobody reads what it left; a load that is
repeated finds its row and writes nothing; and of two that ran at once the readers take one.

The latest records are kept in buckets of entities.  A refresh reads the loads that are new
to it and the buckets in which their entities are, merges these, and writes them anew; all
other buckets stay where they are.  A version of the state is a list of one folder per
bucket and of the loads it holds, written last, so a broken refresh leaves the version
before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from answergrid.operators.latest import latest_per_entity
from answergrid.sources.history import HISTORY_SCHEMA
from answergrid.sources.shared import unique

BUCKETS = 256
_MANIFEST = "load_id STRING, folder STRING"
_STATE = "version LONG, bucket INT, folder STRING, loads ARRAY<STRING>"


def _read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The files at a path; an empty table where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def loads_of(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of every load that is committed: one row per load."""
    rows = _read(spark, f"{path}/manifest", _MANIFEST).groupBy("load_id").agg(F.min("folder").alias("folder")).collect()
    return {r["load_id"]: r["folder"] for r in rows}


def write_load(df: DataFrame, path: str) -> str:
    """Write the rows of a load; they do not count before ``commit_load``."""
    folder = f"{path}/data/{unique()}"
    df.select(*HISTORY_SCHEMA.names).write.parquet(folder)
    return folder


def commit_load(spark: SparkSession, path: str, load_id: str, folder: str) -> None:
    row = spark.createDataFrame([(load_id, folder)], _MANIFEST).coalesce(1)
    row.write.mode("append").parquet(f"{path}/manifest")


def append_load(df: DataFrame, path: str, load_id: str) -> bool:
    """Add a load to a history, once; whether it was new."""
    spark = df.sparkSession
    if load_id in loads_of(spark, path):
        return False
    commit_load(spark, path, load_id, write_load(df, path))
    return True


def read_loads(spark: SparkSession, path: str, load_ids: Sequence[str] | None = None) -> DataFrame:
    """The rows of all committed loads, or of some."""
    folders = [f for i, f in sorted(loads_of(spark, path).items()) if load_ids is None or i in load_ids]
    if not folders:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(*folders)


def _state(spark: SparkSession, path: str) -> tuple[int, dict[int, str], set[str]]:
    """The last version, the folder of each bucket that has rows, and the loads it holds."""
    rows = _read(spark, f"{path}/versions", _STATE)
    last = rows.agg(F.max("version")).first()[0]
    if last is None:
        return 0, {}, set()
    found = rows.where(F.col("version") == last).collect()
    return last, {r["bucket"]: r["folder"] for r in found if r["bucket"] is not None}, {x for r in found for x in r["loads"] or []}


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")


def refresh_latest(spark: SparkSession, history: str, state: str, buckets: int = BUCKETS) -> list[int]:
    """Merge the loads that the state does not hold yet; returns the buckets that were written anew.

    ``buckets`` must stay what it was for a state.
    """
    version, folders, held = _state(spark, state)
    fresh = [i for i in loads_of(spark, history) if i not in held]
    if not fresh:
        return []
    loaded = latest_per_entity(read_loads(spark, history, fresh)).withColumn("bucket", _bucket(buckets))
    touched = sorted(r["bucket"] for r in loaded.select("bucket").distinct().collect())
    before = [folders[b] for b in touched if b in folders]
    known = spark.read.schema(HISTORY_SCHEMA).parquet(*before) if before else spark.createDataFrame([], HISTORY_SCHEMA)
    merged = latest_per_entity(known.withColumn("bucket", _bucket(buckets)).unionByName(loaded))
    folder = f"{state}/data/{unique()}"
    merged.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    folders |= {b: f"{folder}/bucket={b}" for b in touched}
    # The loads are named once, beside no bucket.
    rows = [(version + 1, None, None, sorted({*held, *fresh})), *((version + 1, b, f, None) for b, f in sorted(folders.items()))]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("append").parquet(f"{state}/versions")
    return touched


def read_latest(spark: SparkSession, state: str) -> DataFrame:
    """The latest record of every entity, as of the last refresh."""
    _, folders, _ = _state(spark, state)
    if not folders:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(*folders.values())
