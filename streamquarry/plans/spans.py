"""First, last and number of occurrences of each value in each stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamquarry.plans.chunks import CHUNK, chunk_of

VALUE = ["stream_id", "attr", "val"]


def value_spans(cell_table: DataFrame) -> DataFrame:
    """``stream_id, attr, val, first_pos, last_pos, n``; partially aggregated before the shuffle."""
    return cell_table.groupBy(*VALUE).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n")
    )


def join_spans(cell_table: DataFrame, spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Cells with the columns of the span of their value; values without a span are dropped.

    Spans are repeated per chunk they cover, so a value that fills a long
    stream is not one join key.
    """
    covered = F.sequence(chunk_of(F.col("first_pos"), size), chunk_of(F.col("last_pos"), size))
    by_chunk = spans.withColumn("_chunk", F.explode(covered))
    return (
        cell_table.withColumn("_chunk", chunk_of(F.col("pos"), size))
        .join(by_chunk, [*VALUE, "_chunk"])
        .drop("_chunk")
    )
