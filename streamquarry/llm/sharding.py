"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2^16 places.  A document stands at the place its id hashes to and belongs to the
next virtual node clockwise; each shard owns several virtual nodes.  A shard has a capacity in
rows.  A virtual node serves its own documents first, in the order of the ring, as far as its
shard has room; what is left over continues clockwise to the next node with room.  With
``load_factor=1`` the capacities add up to the number of documents, so counts are at most one
apart; a larger factor moves fewer documents away from home.

Which documents overflow depends only on how many each virtual node has, so the walk is done on
those counts (one per virtual node, a number that does not grow with the data) and gives, per
node, ranges of ranks and the shard they go to.  The documents themselves are ranked within
their place of the ring and pick up their range in a broadcast join.

Null ids have a place of their own; equal ids share a place and are told apart by text, then
by address.  Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamquarry.llm.rows import FILE, ROW, addressed, stored, text_of

PLACES = 1 << 16


def _ring(spark: SparkSession, n_shards: int, v_nodes: int) -> list[tuple[int, int]]:
    """``(place, shard)`` of the virtual nodes in clockwise order; one node per place."""
    nodes = spark.range(n_shards * v_nodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.expr(f"id div {v_nodes}"), F.expr(f"id % {v_nodes}")), F.lit(PLACES)).alias("p"),
        F.expr(f"id div {v_nodes}").alias("s"),
    )
    taken: dict[int, int] = {}
    for p, s in sorted((r.p, r.s) for r in nodes.collect()):  # n_shards * v_nodes rows
        taken.setdefault(p, s)
    return sorted(taken.items())


def capacities(total: int, n_shards: int, load_factor: float) -> list[int]:
    """Rows a shard may hold: the even share rounded down or up, or ``load_factor`` times the mean."""
    if load_factor <= 1:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [int(-(-total * load_factor // n_shards))] * n_shards


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Ranges ``(node, from_rank, to_rank, shard)`` for nodes in clockwise order."""
    room, placed, waiting = list(room), [], [[] for _ in counts]
    for v, (n, shard) in enumerate(zip(counts, owners, strict=True)):
        own = min(n, room[shard])
        room[shard] -= own
        placed += [(v, 0, own, shard)] * (own > 0)
        waiting[v] += [(v, own, n)] * (n > own)
    carried: list[tuple[int, int, int]] = []
    v = 0
    while carried or any(waiting):
        carried, waiting[v] = carried + waiting[v], []
        shard = owners[v]
        while carried and room[shard]:
            home, start, end = carried.pop(0)
            take = min(end - start, room[shard])
            room[shard] -= take
            placed.append((home, start, start + take, shard))
            if start + take < end:
                carried.insert(0, (home, start + take, end))
        v = (v + 1) % len(counts)
    return placed


def shard_rows(
    docs: DataFrame,
    n_shards: int = 8,
    v_nodes: int = 64,
    load_factor: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per document: ``doc_id, size, text_crc32, shard, home, slot``.

    ``home`` is the shard of the first virtual node clockwise, ``slot`` the gapless place in the
    shard, ``size`` the UTF-8 bytes of the text plus 1.
    """
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    keys = stored(
        addressed(docs, id_col, text_col).select(
            id_col, FILE, ROW,
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit("row"), id_col).alias("_at"),
        ).withColumn("_place", F.pmod("_at", F.lit(PLACES))),
        "ring",
    )
    ring = _ring(spark, n_shards, v_nodes)
    nodes = spark.createDataFrame(
        [(i, ring[i - 1][0] if i else -1, p) for i, (p, _) in enumerate(ring)]
        + [(0, ring[-1][0], PLACES - 1)], "_node int, _after int, _upto int",
    )
    # at most 2^16 rows, however many documents there are
    places = nodes.select("_node", F.explode(F.sequence(F.col("_after") + 1, F.greatest(F.col("_upto"), F.col("_after") + 1))).alias("_place")).filter(
        F.col("_place") <= F.col("_upto"))
    per_place = stored(
        keys.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
        .join(F.broadcast(places.withColumn("_place", F.col("_place").cast("bigint"))), "_place"),
        "places",
    )
    first = ring[0][0]
    clockwise = Window.partitionBy("_node").orderBy(F.pmod(F.col("_place") - 1 - first, F.lit(PLACES)))
    before = per_place.withColumn(
        "_before", F.coalesce(F.sum("_n").over(clockwise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")

    counts = dict(per_place.groupBy("_node").agg(F.sum("_n")).collect())  # a row per virtual node
    total = sum(counts.values())
    placed = walk([counts.get(v, 0) for v in range(len(ring))], [s for _, s in ring], capacities(total, n_shards, load_factor))
    base, ranges = [0] * n_shards, []
    for node, start, end, shard in placed:
        ranges.append((node, start, end, shard, base[shard], ring[node][1]))
        base[shard] += end - start
    ranges = spark.createDataFrame(ranges, "_node int, _from bigint, _to bigint, shard int, _base bigint, home int")

    within = Window.partitionBy("_place").orderBy("_at", id_col, "text_crc32", "size", FILE, ROW)
    return (
        keys.withColumn("_in", F.row_number().over(within) - 1)
        .join(F.broadcast(before), "_place")
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .join(F.broadcast(ranges), "_node")
        .filter("_rank >= _from and _rank < _to")
        .select(id_col, "size", "text_crc32", "shard", "home", (F.col("_base") + F.col("_rank") - F.col("_from")).alias("slot"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7``: eight shards of as many documents each, to one row."""
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("home").alias("home_shard"),
    )
