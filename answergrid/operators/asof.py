"""The record of an entity that was valid at a time."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answergrid.functions.names import free_names


def validity(
    history: DataFrame, key: str = "entity_id", order: str = "loaded_at_utc", tie: str = "data"
) -> DataFrame:
    """The history with ``valid_from`` and ``valid_until`` (excluded; NULL for the last record).

    Of records with one time only the last by ``tie`` was ever valid; the others are left
    out.  Records without a time are, too.
    """
    timed = history.where(F.col(order).isNotNull())
    others = [c for c in history.columns if c not in (key, order)]
    (best,) = free_names(history.columns, "best")
    last = timed.groupBy(key, order).agg(F.max_by(F.struct(*others), F.struct(tie)).alias(best))
    whole = last.select(*[c if c in (key, order) else f"{best}.{c}" for c in history.columns])
    following = F.lead(order).over(Window.partitionBy(key).orderBy(order))
    return whole.withColumn("valid_from", F.col(order)).withColumn("valid_until", following)


def as_of(
    events: DataFrame,
    history: DataFrame,
    *,
    key: str,
    at: str,
    history_key: str = "entity_id",
    order: str = "loaded_at_utc",
    tie: str = "data",
    record: str = "record",
    span: timedelta = timedelta(days=1),
) -> DataFrame:
    """The events with ``record``: the last record of their entity with ``order <= at``, as a struct.

    There is no range join.  Time is cut into spans.  The last record of each entity and span
    is found while grouping, and carried forward over the entity's spans, of which there are
    few; then every span of every entity is worked off by itself: its records and events in
    the order of time, each event with the last record before it.  So an entity with a third
    of all rows is shared out by its spans, and each row is shuffled once.

    Events without a key or a time, and those before the first record, keep a NULL record.
    Records without a key or a time are valid for none.  ``tie`` decides between records of
    one time.  A column named ``record`` is replaced.
    """
    events = events.drop(record)
    seconds = max(1, int(span.total_seconds()))
    part_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    own, rec = F.struct(*events.columns).alias("event"), F.struct(*history.columns).alias("rec")
    when = lambda c: F.col(c).cast("timestamp").alias("time")
    known = history.where(F.col(order).isNotNull() & F.col(history_key).isNotNull()).select(
        F.col(history_key).alias("entity"), part_of(order).alias("part"), when(order), F.col(tie).alias("tie"), rec
    )
    asked = events.select(F.col(key).alias("entity"), part_of(at).alias("part"), when(at), own)
    timed = F.col("entity").isNotNull() & F.col("time").isNotNull()

    lasts = known.groupBy("entity", "part").agg(F.max_by("rec", F.struct("time", "tie")).alias("rec"))
    parts = asked.where(timed).select("entity", "part").distinct()
    before = Window.partitionBy("entity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = lasts.withColumn("asked", F.lit(False)).unionByName(parts.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    both = both.groupBy("entity", "part").agg(F.first("rec", ignorenulls=True).alias("rec"), F.max("asked").alias("asked"))
    carried = both.withColumn("rec", F.last("rec", ignorenulls=True).over(before)).where("asked").select("entity", "part", "rec")

    # In a span: what is carried in, then records before events of the same time.
    rows = (
        carried.withColumn("rank", F.lit(0))
        .unionByName(known.withColumn("rank", F.lit(1)), allowMissingColumns=True)
        .unionByName(asked.where(timed).withColumn("rank", F.lit(2)), allowMissingColumns=True)
    )
    order_in = Window.partitionBy("entity", "part").orderBy(F.col("time").asc_nulls_first(), "rank", F.col("tie").asc_nulls_first())
    so_far = order_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("rec", F.last("rec", ignorenulls=True).over(so_far)).where("rank = 2").select("event", "rec")
    none = asked.where(~timed | timed.isNull()).select("event", F.lit(None).cast(known.schema["rec"].dataType).alias("rec"))
    return found.unionByName(none).select(*[F.col("event")[c].alias(c) for c in events.columns], F.col("rec").alias(record))
