"""Reader for traces: plain or gzipped text, one stream per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_traces(spark: SparkSession, path: str, n_attrs: int | None = None) -> DataFrame:
    """Read lines of blank-separated events whose attributes each end with ``;``.

    Whatever follows the last digit, point or semicolon of a line is cut off if
    the line uses semicolons; otherwise only white space is.  ``stream_id`` is
    ``file:line`` with the line number counted from 0, the same on every run:
    lines are counted per input block, and blocks are added up per file.
    Without ``n_attrs`` the widest event sets the number of attributes.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    blocks = lines.groupBy("_file", "_block").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    numbered = lines.join(blocks, ["_file", "_block"]).select(
        F.concat_ws(
            ":", F.col("_file"), F.col("_shift") + F.col("_row") - F.col("_first")
        ).alias("stream_id"),
        F.col("value"),
    )
    clean = F.when(
        F.contains(F.col("value"), F.lit(";")),
        F.regexp_replace("value", r"[^0-9.;]+$", ""),
    ).otherwise(F.regexp_replace("value", r"\s+$", ""))
    events = (
        numbered.withColumn("_events", F.filter(F.split(clean, r"\s+"), lambda e: e != ""))
        .select("stream_id", F.posexplode("_events").alias("pos", "_event"))
    )
    ended = F.endswith(F.col("_event"), F.lit(";"))
    parts = F.split("_event", ";", -1)
    parts = F.when(ended, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    events = events.select("stream_id", "pos", parts.alias("_parts"))
    if n_attrs is None:
        n_attrs = events.agg(F.max(F.size("_parts"))).first()[0] or 1
    return events.select(
        "stream_id", "pos",
        *[F.nullif(F.get("_parts", F.lit(i)), F.lit("")).alias(f"a{i}") for i in range(n_attrs)],
    )
