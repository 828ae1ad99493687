"""Choosing events and streams of a stream database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamquarry.functions.columns import attributes
from streamquarry.plans.chunks import keep_streams
from streamquarry.plans.workspace import broadcast_if_small


def keep_last(sdb: DataFrame, k: int) -> DataFrame:
    """The last k events of each stream, numbered from 0 again.

    The rank has a limit, so each input task passes on at most k events of a
    stream and the window over the rest is bounded by k as well.
    """
    back = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("pos")))
    kept = sdb.withColumn("_back", back).filter(F.col("_back") <= k)
    size = F.count(F.lit(1)).over(Window.partitionBy("stream_id"))
    return kept.select(
        "stream_id", (size - F.col("_back")).cast("int").alias("pos"), *attributes(sdb)
    )


def drop_longer_than(sdb: DataFrame, n: int) -> DataFrame:
    """Streams with at most n events.

    A stream is too long exactly when it has an event at position n, so nothing
    is counted, and events from position n on never reach the join.
    """
    too_long = sdb.filter(F.col("pos") == n).select("stream_id")
    return sdb.filter(F.col("pos") < n).join(too_long, "stream_id", "left_anti")


def require_values(sdb: DataFrame, values: list[str]) -> DataFrame:
    """Streams that contain every given value, in any attribute."""
    attrs = attributes(sdb)
    found = [
        F.max(reduce(lambda x, y: x | y, [F.coalesce(F.col(a) == v, F.lit(False)) for a in attrs]))
        .alias(f"_v{i}")
        for i, v in enumerate(values)
    ]
    ids = sdb.groupBy("stream_id").agg(F.max("pos").alias("last_pos"), *found)
    for i in range(len(values)):
        ids = ids.filter(F.col(f"_v{i}"))
    return keep_streams(sdb, ids.select("stream_id", "last_pos"))


def limit_streams(sdb: DataFrame, n: int) -> DataFrame:
    """The first n streams by ``stream_id``."""
    ids = sdb.filter(F.col("pos") == 0).select("stream_id").orderBy("stream_id").limit(n)
    return sdb.join(broadcast_if_small(ids, n), "stream_id", "left_semi")
