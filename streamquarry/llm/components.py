"""Connected components of a graph given as links, by alternating large and small stars.

Each step hangs neighbours onto the smallest node near them; only minima per node are
aggregated and joined back, so a node with very many links is one record per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from streamquarry.llm.rows import stored

TASKS, ROWS = 16, 20_000  # tasks that write a step's links: so many, or one per so many links if that is more


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (``u > v``) with the far ends hung onto the smallest neighbour of each node."""
    if large:
        near = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def _summed(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges`` stored, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    written = stored(edges.observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return written, seen.get


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node with a link; ``links`` has ``a, b``; the label is the smallest node."""
    edges, state = _summed(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # one plan for both would hold the large stars once per use; the driver plans it again after each stage
        # and links are short rows: a task for few of them costs more than its work
        tasks = max(TASKS, state["n"] // ROWS)
        large = stored(_stars(edges, large=True).coalesce(tasks), "stars")
        last, (edges, state) = state, _summed(_stars(large, large=False).coalesce(tasks))
        if state == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
