"""Occurrence index of a stream database, as intervals of positions.

A row says: in this stream, for every position ``p0`` with ``lo <= p0 < pos``,
the next event that holds the item set ``pre`` plus one more value of a later
attribute is the one at ``pos``.  Finding the earliest continuation of a match
is then one equi join on ``(stream_id, chunk, pre)`` with an interval test, and
every occurrence is stored once per chunk of positions it serves.

Values are coded within their stream by the position of their first
occurrence, which is exact, needs no dictionary and fits into integers however
many distinct values the database has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from streamquarry.functions.columns import attributes, cells
from streamquarry.plans.chunks import chunk_levels, chunk_of, covering_nodes
from streamquarry.plans.spans import join_spans, value_spans
from streamquarry.plans.workspace import broadcast_if_small, materialize

# Positions per chunk of the index: bounds the occurrences one join key holds.
INDEX_CHUNK = 64


@dataclass
class OccurrenceIndex:
    """``rows``: stream_id, pre, key, bc, vid, last, lo, pos, partitioned by ``join_keys``.

    ``join_keys`` are stream_id and pre, and chunk if a stream is longer than one.
    ``key`` is the code of the value that the row adds to ``pre``, ``bc`` the
    code used in variable bindings (equal only for equal values of the same
    attribute), ``vid`` the id of a supported value or NULL, ``last`` the last
    position of the value in the stream.
    """

    rows: DataFrame
    values: DataFrame  # vid, attr, val
    n_values: int
    n_attrs: int
    packed: bool
    join_keys: list[str]
    levels: int

    @property
    def empty_item_set(self) -> str:
        return "0L" if self.packed else "''"

    def with_value(self, pre: str, key: str) -> str:
        return f"{pre} + {key}" if self.packed else f"concat({pre}, {key})"


def build_index(
    sdb: DataFrame, needed: int, max_pos: int, use_values: bool = True, use_variables: bool = True,
    write: Callable[[DataFrame, str], DataFrame] = materialize,
) -> OccurrenceIndex:
    """Index the cells that can matter: supported values, and values that repeat in their stream."""
    n_attrs = len(attributes(sdb))
    bits = (max_pos + 1).bit_length()
    packed = bits * n_attrs <= 62
    found = cells(sdb)
    spans = value_spans(found)
    # A supported value needs `needed` streams: their number is bounded by the
    # cells per stream and the support, not by the size of the database.
    values = write(
        spans.groupBy("attr", "val").agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") >= needed) & F.lit(use_values))
        .select(F.monotonically_increasing_id().alias("vid"), "attr", "val"),
        "values",
    )
    n_values = values.count()
    useful = spans.join(broadcast_if_small(values, n_values), ["attr", "val"], "left").filter(
        F.col("vid").isNotNull() | (F.lit(use_variables) & (F.col("n") > 1))
    )
    code = F.col("first_pos").cast("bigint")
    if packed:
        key = F.expr(f"shiftleft(cast(first_pos + 1 as bigint), cast(attr * {bits} as int))")
    else:
        key = F.concat_ws(":", "attr", "first_pos")
        key = F.concat(key, F.lit(";"))
    coded = join_spans(found, useful).select(
        "stream_id", "pos",
        F.struct(
            "attr", key.alias("key"), (code * n_attrs + F.col("attr")).alias("bc"), "vid",
            F.col("last_pos").alias("last"),
        ).alias("item"),
    )
    # at most one item per attribute and event
    events = coded.groupBy("stream_id", "pos").agg(F.sort_array(F.collect_list("item")).alias("items"))
    keys = ["stream_id", "pre"] + (["chunk"] if max_pos >= INDEX_CHUNK else [])
    index = OccurrenceIndex(events, values, n_values, n_attrs, packed, keys, chunk_levels(max_pos, INDEX_CHUNK))
    prefixes = f"""aggregate(
        slice(items, 1, i), array({index.empty_item_set}),
        (done, c) -> concat(done, transform(done, s -> {index.with_value('s', 'c.key')})))"""
    item_sets = (
        events.select("stream_id", "pos", "items", F.posexplode("items").alias("i", "item"))
        .select("stream_id", "pos", "item.*", F.explode(F.expr(prefixes)).alias("pre"))
        .drop("attr")
    )
    # partitioned and sorted once: the join of each level only shuffles its state
    index.rows = _intervals(item_sets, max_pos).repartition(
        int(sdb.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys
    ).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    index.rows.count()  # Spark knows the layout of a cached table once it is filled
    return index


def _intervals(item_sets: DataFrame, max_pos: int) -> DataFrame:
    same = ["stream_id", "pre", "key"]
    if max_pos < INDEX_CHUNK:
        window = Window.partitionBy(*same).orderBy("pos")
        return item_sets.withColumn("lo", F.lag("pos", 1, -1).over(window))
    in_chunk = Window.partitionBy(*same, "chunk")
    placed = (
        item_sets.withColumn("chunk", chunk_of(F.col("pos"), INDEX_CHUNK))
        .withColumn("lo", F.lag("pos").over(in_chunk.orderBy("pos")))
        .withColumn("_end", F.max("pos").over(in_chunk))
    )
    # the first occurrence of a chunk continues from the last one of an earlier chunk
    heads = placed.filter(F.col("lo").isNull()).withColumn(
        "lo", F.lag("_end", 1, -1).over(Window.partitionBy(*same).orderBy("chunk"))
    )
    rest = placed.filter(F.col("lo").isNotNull())
    served = covering_nodes(
        chunk_of(F.col("lo"), INDEX_CHUNK), chunk_of(F.col("pos") - 1, INDEX_CHUNK),
        chunk_levels(max_pos, INDEX_CHUNK),
    )
    return heads.unionByName(rest).drop("_end").withColumn("chunk", F.explode(served))
