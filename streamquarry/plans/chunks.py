"""Position chunks: how one very long stream is spread over many tasks.

Joins within streams are equi joins on ``(stream_id, chunk)`` with
``chunk = pos div size``.  A stream no longer than ``size`` has the single
chunk 0, so ordinary streams cost nothing extra; a stream that holds a third
of all events becomes many join keys of at most ``size`` events each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_of(pos: Column, size: int = CHUNK) -> Column:
    return F.floor(F.greatest(pos, F.lit(0)) / F.lit(size)).cast("int")


# Nodes of a binary tree over the chunks of a stream: node x of level l covers 2^l chunks from
# x * 2^l on.  An interval is a few nodes per level, a position lies in one node of each level.
_NODE_LEVEL = 40  # bits below the level in the number of a node


def chunk_levels(max_pos: int, size: int) -> int:
    """Levels above the chunks themselves that intervals up to ``max_pos`` can use."""
    return max(0, (max_pos // size).bit_length())


def covering_nodes(first: Column, last: Column, levels: int) -> Column:
    """The fewest nodes that together cover the chunks ``first`` to ``last``."""

    def of_level(level: Column) -> Column:
        def inside(x: Column, above: int) -> Column:
            width = F.pow(F.lit(2), level + above).cast("bigint")
            return (x * width >= first) & ((x + 1) * width - 1 <= last)

        width = F.pow(F.lit(2), level).cast("bigint")
        lowest = F.ceil(first / width)
        highest = F.floor((last + 1) / width) - 1
        ends = F.filter(
            F.array_distinct(F.array(lowest, highest)),
            lambda x: (lowest <= highest) & inside(x, 0) & ~inside(F.floor(x / 2), 1),
        )
        return F.transform(ends, lambda x: level.cast("bigint") * (1 << _NODE_LEVEL) + x)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))


def nodes_of(chunk: Column, levels: int) -> Column:
    """The node of each level that holds a chunk."""
    return F.array(*[
        F.lit(level << _NODE_LEVEL) + F.floor(chunk / (1 << level)) for level in range(levels + 1)
    ])


def stream_ends(sdb: DataFrame) -> DataFrame:
    """One row per stream with its last position (partial aggregation first)."""
    return sdb.groupBy("stream_id").agg(F.max("pos").alias("last_pos"))


def longest_position(sdb: DataFrame) -> int:
    """Last position of the longest stream; one small result row."""
    return sdb.agg(F.max("pos")).first()[0] or 0


def keep_streams(sdb: DataFrame, ids: DataFrame, how: str = "left_semi", size: int = CHUNK) -> DataFrame:
    """Semi or anti join of a stream database with ``ids(stream_id, last_pos)``.

    Each id is repeated once per chunk of its stream, so the events of a long
    stream do not meet in one task.
    """
    keys = ids.select(
        "stream_id",
        F.explode(F.sequence(F.lit(0), chunk_of(F.col("last_pos"), size))).alias("_chunk"),
    )
    return (
        sdb.withColumn("_chunk", chunk_of(F.col("pos"), size))
        .join(keys, ["stream_id", "_chunk"], how)
        .drop("_chunk")
    )


def chosen_streams(sdb: DataFrame, streams: DataFrame, size: int = CHUNK) -> DataFrame:
    """The events of the streams that ``streams`` names; long streams by chunks."""
    wanted = stream_ends(sdb).join(streams.select("stream_id").distinct(), "stream_id", "left_semi")
    return keep_streams(sdb, wanted, size=size)


def overlapping_chunks(sdb: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """Add ``_chunk``; the first ``overlap`` events of a chunk are repeated in the one before.

    A window over ``(stream_id, _chunk)`` then sees, for every event of its own
    chunk, the next ``overlap`` events of the stream.  ``_own`` marks the
    events that are not repetitions.
    """
    size = max(size, overlap + 1)
    own = chunk_of(F.col("pos"), size)
    repeat = (F.col("pos") % size < overlap) & (own > 0)
    return (
        sdb.withColumn("_home", own)
        .withColumn("_chunk", F.explode(F.when(repeat, F.array(own, own - 1)).otherwise(F.array(own))))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )
