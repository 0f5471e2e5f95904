"""Mixing sources to target weights by Poisson replication.

A source with n rows and target weight w is to fill w of all rows made, so each of
its rows is to be repeated ``w * total / n`` times on average. The number of copies
of a row is the value of a Poisson variable with that mean at a number between 0 and
1 that the row's id and the seed decide: the smallest k whose cumulated probability
reaches it. Rows are then exploded into their copies and shuffled globally by a hash
of id, copy and seed: partitions by it, and order within them.

The probabilities are a short array per source, made once. Row counts of sources are
taken first, from the source column alone; the table of sources is written and
joined, and Spark broadcasts it if its size permits, else it splits hot sources.

Cases: a NULL source is a source of its own, named by the weight under None. Weights
not given are equal for all sources; where weights are given, sources without one get
none. Weights that add up to 0 give no rows. Repeated rows (same id) get the same
number of copies. A NULL id is drawn like any other. An empty table stays empty.
Columns named ``copy``, ``n_copies`` or ``shuffle_key`` are replaced, all others go through,
whatever their names. Means beyond
``MOST_MEAN`` are split into whole rounds of it, whose draws are independent: a sum
of Poisson variables is one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergrid.functions.names import free_names
from answergrid.llm.batches import stored

#: Largest mean drawn at once; its tail beyond TERMS has a probability below 2^-52.
MOST_MEAN = 16.0
TERMS = 80


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: 48 bits, the same in any SQL."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def cumulated(mean: Column) -> Column:
    """The Poisson probabilities of at most 0, 1, 2, ... copies."""
    zero = F.lit(0.0)
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("all"), F.exp(-mean).alias("sum"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["all"], F.array(s["sum"] + s["p"] * mean / k)).alias("all"),
            (s["sum"] + s["p"] * mean / k).alias("sum"),
        ),
        lambda s: s["all"],
    )
    return F.when(mean > zero, step).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict | None, total: float | None) -> DataFrame:
    """``source, n, rounds, odds``: per source its rows, and how its copies are drawn."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "s string, weight double"
        )
        weighted = counts.join(named, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").fillna({"weight": 0.0})
    written = stored(weighted, "source-counts")
    all_rows, all_weights = written.agg(F.sum("n"), F.sum("weight")).first()
    wanted = float(total if total is not None else all_rows or 0)
    mean = F.lit(wanted) * F.col("weight") / F.lit(float(all_weights or 1.0) or 1.0) / F.col("n")
    rounds = F.greatest(F.lit(1), F.ceil(mean / MOST_MEAN)).cast("int")
    return written.select(
        "source", "n", mean.alias("mean"), rounds.alias("rounds"), cumulated(mean / rounds).alias("odds")
    )


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    total: float | None = None,
    seed: int = 42,
    id_column: str = "doc_id",
) -> DataFrame:
    """The documents repeated so that sources reach their weights, in a random order.

    ``total`` is the number of rows to expect; without it, as many as there are. Adds
    ``copy`` (from 0), ``n_copies`` and ``shuffle_key``.
    """
    plain = docs.drop("copy", "n_copies", "shuffle_key")
    own, rounds, odds = free_names([*plain.columns, "copy", "n_copies", "shuffle_key"], "own_source", "rounds", "odds")
    rates = stored(source_rates(plain, weights, total), "source-rates")
    rates = rates.select(F.col("source").alias(own), F.col("rounds").alias(rounds), F.col("odds").alias(odds))
    drawn = plain.join(rates, F.col("source").eqNullSafe(F.col(own)))
    one = lambda r: F.size(F.filter(odds, lambda p: p <= uniform(F.col(id_column), F.lit(seed), r)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col(rounds)), F.lit(0), lambda n, r: n + one(r))
    counted = drawn.withColumn("n_copies", copies).drop(own, rounds, odds).where("n_copies > 0")
    exploded = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = exploded.withColumn("shuffle_key", uniform(F.col(id_column), F.lit(seed), F.lit("order"), F.col("copy")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_column, "copy")
