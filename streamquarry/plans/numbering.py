"""Row numbers within keys, also for keys that hold a large part of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamquarry.plans.workspace import broadcast_if_small, materialize

# A key with more rows than this is numbered by range partitions.
HOT_ROWS = 5_000_000


def number_rows(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    out: str = "pos",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the 0-based place of each row within ``keys`` by ``order_by``.

    Ordinary keys use one window.  The rows of keys above ``hot_rows`` are range
    partitioned by key and order, so one key spreads over many tasks; each
    range is numbered on its own and shifted by the sizes of the ranges before
    it.  ``hot_rows=None`` states that no key is large and skips the check.
    """
    if hot_rows is None:
        return _number_by_window(df, keys, order_by, out)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_rows)
    size = hot.agg(F.count(F.lit(1)), F.sum("_n")).first()
    n_hot, n_hot_rows = size[0], size[1] or 0
    if n_hot == 0:
        return _number_by_window(df, keys, order_by, out)
    n_ranges = max(2, -(-4 * n_hot_rows // hot_rows))
    if not keys:
        return _number_by_range(df, keys, order_by, out, n_ranges)
    # at most n_rows / hot_rows keys are hot
    hot_keys = broadcast_if_small(hot.select(*keys), n_hot)
    ranged = _number_by_range(df.join(hot_keys, keys, "left_semi"), keys, order_by, out, n_ranges)
    rest = _number_by_window(df.join(hot_keys, keys, "left_anti"), keys, order_by, out)
    return rest.unionByName(ranged.select(rest.columns))


def _place(window: Window) -> Column:
    return F.row_number().over(window) - 1


def _number_by_window(df, keys, order_by, out):
    return df.withColumn(out, _place(Window.partitionBy(*keys).orderBy(*order_by)).cast("bigint"))


def _number_by_range(df, keys, order_by, out, n_ranges):
    # written once: range borders come from sampling, so they must not be drawn again
    ranged = materialize(
        df.repartitionByRange(int(n_ranges), *keys, *order_by).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    shifts = broadcast_if_small(shifts, int(n_ranges) * 2)
    window = Window.partitionBy(*keys, "_range").orderBy(*order_by)
    return (
        ranged.withColumn("_place", _place(window))
        .join(shifts, [*keys, "_range"])
        .withColumn(out, (F.col("_place") + F.col("_shift")).cast("bigint"))
        .drop("_range", "_place", "_shift")
    )
