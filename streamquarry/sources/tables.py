"""Stream databases from tables, and their storage.

A stream database has the columns ``stream_id``, ``pos`` (from 0, no holes) and
one string column per attribute, ``a0, a1, ...``; NULL is an unset attribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamquarry.plans.numbering import HOT_ROWS, number_rows


def _attribute_columns(attrs: list[str | Column]) -> list[Column]:
    columns = [F.col(a) if isinstance(a, str) else a for a in attrs]
    return [
        F.nullif(c.cast("string"), F.lit("")).alias(f"a{i}") for i, c in enumerate(columns)
    ]


def streams_from_table(
    df: DataFrame,
    key: str,
    order_by: list[str],
    attrs: list[str | Column],
    last: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One stream per ``key``, its rows ordered by ``order_by`` (a total order).

    Rows without a key form no stream.

    ``last=k`` keeps the last k events of each stream.  The ranking then has a
    limit per key, which Spark applies before the shuffle, so a key with very
    many rows sends only k of them per input task.
    """
    rows = df.select(
        F.col(key).alias("stream_id"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
        *_attribute_columns(attrs),
    ).filter(F.col("stream_id").isNotNull())
    order = [f"_o{i}" for i in range(len(order_by))]
    names = [f"a{i}" for i in range(len(attrs))]
    if last is None:
        numbered = number_rows(rows, ["stream_id"], order, "pos", hot_rows)
        return numbered.select("stream_id", F.col("pos").cast("int"), *names)
    newest_first = Window.partitionBy("stream_id").orderBy(*[F.desc(c) for c in order])
    kept = rows.withColumn("_back", F.row_number().over(newest_first)).filter(
        F.col("_back") <= last
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("stream_id"))
    return kept.select("stream_id", (size - F.col("_back")).cast("int").alias("pos"), *names)


def streams_before_match(
    df: DataFrame,
    key: str,
    order_by: list[str],
    attrs: list[str | Column],
    seed: Column,
    n_before: int,
    max_matches: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One stream per row that fulfils ``seed``: the ``n_before`` events before it.

    Rows without a key form no stream; matches without any event before them give none.
    The stream id is the text ``key:pos``.  A caller may ask for the first ``max_matches``
    matches in the order ``order_by, key`` only; these are numbered from 0.  Windows
    may overlap.  Every match lists the positions it needs, so the join is an
    equi join on ``(key, pos)`` and no key meets itself as a whole.
    """
    order = [f"_o{i}" for i in range(len(order_by))]
    names = [f"a{i}" for i in range(len(attrs))]
    rows = df.select(
        F.col(key).alias("_key"),
        *[F.col(c).alias(o) for c, o in zip(order_by, order, strict=True)],
        F.coalesce(seed, F.lit(False)).alias("_seed"),
        *_attribute_columns(attrs),
    ).filter(F.col("_key").isNotNull())
    numbered = number_rows(rows, ["_key"], order, "_at", hot_rows)
    matches = numbered.filter(F.col("_seed") & (F.col("_at") > 0)).select(
        "_key", F.col("_at").alias("_match"), *order
    )
    if max_matches is None:
        ids = matches.select(
            "_key", "_match", F.concat_ws(":", "_key", "_match").alias("stream_id")
        )
    else:
        first = matches.orderBy(*order, "_key").limit(max_matches)
        # numbers max_matches rows at most
        place = F.row_number().over(Window.orderBy(*order, "_key")) - 1
        ids = first.select("_key", "_match", place.cast("bigint").alias("stream_id"))
    start = F.greatest(F.col("_match") - n_before, F.lit(0))
    wanted = ids.select(
        "_key", "stream_id", start.alias("_start"),
        F.explode(F.sequence(start, F.col("_match") - 1)).alias("_at"),
    )
    return wanted.join(numbered.select("_key", "_at", *names), ["_key", "_at"]).select(
        "stream_id", (F.col("_at") - F.col("_start")).cast("int").alias("pos"), *names
    )


def write_streams(sdb: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a stream database as parquet, ordered by stream and position.

    Range partitioning on both columns lets a long stream span several files,
    and readers of single streams skip row groups by their statistics.
    """
    (
        sdb.repartitionByRange("stream_id", "pos")
        .sortWithinPartitions("stream_id", "pos")
        .write.mode(mode)
        .parquet(path)
    )


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored stream database."""
    return spark.read.parquet(path)
