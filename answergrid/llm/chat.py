"""Chat formatting: collapse cumulative snapshots, then render what is left.

Logs often hold a conversation once per turn, each time with all turns so far. Every
turn gets a hash of its role and text; the rolling hash of a prefix is the XOR of
128-bit hashes of (position, turn hash) up to there, a running sum that can be taken
in parts. A conversation whose whole hash is the hash of a proper prefix of another
one is a snapshot: an anti-join drops it. Of conversations with equal turns the one
with the smallest conv_id stays. Only hashes move until then; texts are read again
for the conversations that stay.

Turns are numbered and summed in chunks of ``CHUNK`` turn numbers, and chunks by their
totals, so that a conversation of any length is spread over tasks. A chat is rendered
in one part per chunk for the same reason; a shorter conversation has part 0 alone.

Cases: turns are ordered by number (NULL first), equal numbers by role and text hash;
repeated rows are turns of their own. NULL conv_id is one conversation. NULL role and
NULL text render as empty, but differ from empty ones when compared. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergrid.llm.batches import stored

CHUNK = 1024


def _hash(seed: int, *parts: Column) -> Column:
    flat = [x for p in parts for x in (p.isNull(), F.coalesce(p.cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(seed), *flat)


def _chunk() -> Column:
    return F.floor(F.coalesce(F.col("turn"), F.lit(0)) / CHUNK).cast("long")


def prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, p1, p2, n``: the rolling hash of every prefix, and the whole length."""
    turns = conversations.select(
        "conv_id", _chunk().alias("chunk"), "turn", _hash(1, F.col("role"), F.col("text")).alias("h1"), _hash(2, F.col("role"), F.col("text")).alias("h2")
    )
    turns = stored(turns, "turn-hashes")
    own, chunk = F.col("conv_id"), F.col("chunk")
    before = Window.partitionBy("c").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    sizes = turns.groupBy(own.alias("c"), chunk.alias("k")).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(
        "c", "k", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n")
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "h1", "h2")
    placed = turns.join(sizes, own.eqNullSafe(F.col("c")) & (chunk == F.col("k"))).withColumn(
        "position", F.col("offset") + F.row_number().over(inside)
    )
    hashed = placed.select(
        "conv_id", "chunk", "position", "n", *[F.xxhash64("position", F.lit(s), "h1", "h2").alias(f"x{s}") for s in (1, 2)]
    )
    hashed = stored(hashed, "turn-places")
    totals = hashed.groupBy(own.alias("c"), chunk.alias("k")).agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    totals = totals.select("c", "k", *[F.coalesce(F.bit_xor(f"t{s}").over(before), F.lit(0)).alias(f"o{s}") for s in (1, 2)])
    running = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.join(totals, own.eqNullSafe(F.col("c")) & (chunk == F.col("k")))
    return summed.select(
        "conv_id", "position", "n", *[F.col(f"o{s}").bitwiseXOR(F.bit_xor(f"x{s}").over(running)).alias(f"p{s}") for s in (1, 2)]
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies``: the conversations that no longer one begins with."""
    rolled = stored(prefixes(conversations), "turn-prefixes")
    logged = (
        rolled.where("position = n")
        .groupBy("n", "p1", "p2")
        .agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("conv_id"))).alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    begun = rolled.where("position < n").select(F.col("position").alias("n"), "p1", "p2").distinct()
    return logged.join(begun, ["n", "p1", "p2"], "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), F.col("n").alias("n_turns"), "copies"
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, copies, chat``: maximal conversations, rendered.

    A turn is ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break.
    ``copies`` counts the equal conversations.
    """
    kept = stored(maximal(conversations), "maximal-conversations")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    turn = F.concat(F.lit("<|im_start|>"), empty(F.col("role")), F.lit("\n"), empty(F.col("text")), F.lit("<|im_end|>\n"))
    turns = conversations.select(
        F.col("conv_id").alias("c"), _chunk().alias("part"), "turn", _hash(1, F.col("role"), F.col("text")).alias("h1"), _hash(2, F.col("role"), F.col("text")).alias("h2"), turn.alias("said")
    )
    found = turns.join(kept, F.col("c").eqNullSafe(F.col("conv_id")))
    parts = found.groupBy("conv_id", "part").agg(
        F.any_value("n_turns").alias("n_turns"),
        F.any_value("copies").alias("copies"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "said"))), lambda t: t["said"]), "").alias("chat"),
    )
    return parts.select("conv_id", "part", "n_turns", "copies", "chat")
