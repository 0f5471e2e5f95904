"""The row-local operators on streams of files.

Field extraction and packing need no state, so ``fields_as_columns`` and
``pack_rows`` take a streaming DataFrame as they are.  What a stream adds is a
source, an append-only sink and a checkpoint that survives a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from answergrid.operators.ingest import Header
from answergrid.sources.shared import shared_dir


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    file_format: str = "parquet",
    files_per_trigger: int | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def stream_grid(
    spark: SparkSession, path: str, width: int, *, sep: str = ",", files_per_trigger: int | None = None
) -> DataFrame:
    """New grid files as a stream of ``cells``, without a row order.

    Such files come without header rows: see ``known_header``.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    reader = spark.readStream.schema(schema).options(sep=sep, quote='"', escape='"')
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path).select(F.array(*schema.names).alias("cells"))


def known_header(columns: dict[str, int], missing: list[str] | None = None) -> Header:
    """The header of a stream, which has no row order to search one in.

    ``pack_rows`` takes it with the stream and packs every row.
    """
    return Header(row_no=None, columns=columns, missing=missing or [])


def append_stream(
    df: DataFrame,
    path: str,
    name: str,
    *,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream to a folder of Parquet files, each row once.

    The checkpoint lies in the shared folder under ``name``: a restart under
    the same name goes on where the last run ended.
    """
    place = checkpoint or f"{shared_dir(df.sparkSession)}/streams/{name}"
    writer = df.writeStream.outputMode("append").format("parquet").queryName(name)
    writer = writer.option("checkpointLocation", place)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
