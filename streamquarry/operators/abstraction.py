"""Abstractions of attribute values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamquarry.functions.columns import attributes, cells
from streamquarry.plans.numbering import HOT_ROWS, number_rows
from streamquarry.plans.workspace import broadcast_if_small, materialize


def project(sdb: DataFrame, attrs: list[str]) -> DataFrame:
    """Keep the given attributes, renamed to ``a0, a1, ...`` in the given order."""
    return sdb.select(
        "stream_id", "pos", *[F.col(a).alias(f"a{i}") for i, a in enumerate(attrs)]
    )


def split_attributes(sdb: DataFrame) -> dict[str, DataFrame]:
    """One single-attribute stream database per attribute."""
    return {a: project(sdb, [a]) for a in attributes(sdb)}


def uniquify_frequent(
    sdb: DataFrame,
    attrs: list[str] | None = None,
    exact: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Make frequent values unique, so that they never match again.

    A value is frequent if its relative frequency within its attribute is above
    mean plus population standard deviation of these frequencies.  Occurrence i
    becomes ``value,i`` by a counter in stream order; with ``exact=False`` the
    suffix is ``stream:pos``, which needs no counting at all.
    """
    attrs = attrs or attributes(sdb)
    index = {int(a[1:]): a for a in attrs}
    chosen = cells(sdb).filter(F.col("attr").isin(list(index)))
    counts = chosen.groupBy("attr", "val").agg(F.count(F.lit(1)).alias("n"))
    # mean + stddev of n / total is (mean + stddev of n) / total: totals cancel out
    limits = counts.groupBy("attr").agg(
        (F.avg("n") + F.stddev_pop("n")).alias("_limit")
    )
    frequent = (
        counts.join(F.broadcast(limits), "attr")  # one row per attribute
        .filter(F.col("n") > F.col("_limit"))
        .select("attr", "val")
    )
    if not exact:
        frequent = materialize(frequent, "frequent")
        n_frequent = frequent.count()
        for i, a in index.items():
            own = frequent.filter(F.col("attr") == i).select(F.col("val").alias("_val"))
            renamed = F.concat(F.col(a), F.lit(","), F.concat_ws(":", "stream_id", "pos"))
            sdb = sdb.join(broadcast_if_small(own, n_frequent), F.col(a) == F.col("_val"), "left").withColumn(
                a, F.when(F.col("_val").isNull(), F.col(a)).otherwise(renamed)
            ).drop("_val")
        return sdb
    hits = chosen.join(frequent, ["attr", "val"], "left_semi")
    numbered = number_rows(hits, ["attr", "val"], ["stream_id", "pos"], "_i", hot_rows)
    renamed = F.concat_ws(",", "val", "_i")
    new_values = numbered.groupBy("stream_id", "pos").agg(
        *[F.max(F.when(F.col("attr") == i, renamed)).alias(f"_{a}") for i, a in index.items()]
    )
    return sdb.join(new_values, ["stream_id", "pos"], "left").select(
        "stream_id", "pos",
        *[
            F.coalesce(F.col(f"_{a}"), F.col(a)).alias(a) if a in attrs else F.col(a)
            for a in attributes(sdb)
        ],
    )


def mask_values(sdb: DataFrame, attr: str, values: list[str]) -> DataFrame:
    """Set the given values of an attribute to unset."""
    return sdb.withColumn(attr, F.when(~F.col(attr).isin(values), F.col(attr)))


def mask_top_values(sdb: DataFrame, attr: str, n: int) -> DataFrame:
    """Set the n most frequent values of an attribute (ties: smallest) to unset."""
    top = (
        sdb.filter(F.col(attr).isNotNull())
        .groupBy(F.col(attr).alias("_top"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_top")
        .limit(n)
        .select("_top")
    )
    joined = sdb.join(broadcast_if_small(top, n), F.col(attr) == F.col("_top"), "left")
    return joined.withColumn(attr, F.when(F.col("_top").isNull(), F.col(attr))).drop("_top")


def bin_values(
    sdb: DataFrame,
    attr: str,
    n: int,
    exact: bool = False,
    accuracy: int = 100_000,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Replace a numeric attribute by the number (from 0) of one of n equal-sized groups.

    Default: n - 1 cut points by approximate percentiles, equal values share a
    group.  ``exact=True`` gives groups whose sizes differ by at most one, ties
    broken by stream and position; places come from range partitions, so no
    task sees the whole table.
    """
    number = F.col(attr).cast("double")
    if exact:
        ranked = number_rows(
            sdb.filter(number.isNotNull()).withColumn("_v", number),
            [], ["_v", "stream_id", "pos"], "_rank", hot_rows,
        )
        total = ranked.count()
        small, n_large = divmod(total, n)
        border = n_large * (small + 1)
        rank = F.col("_rank")
        group = F.when(rank < border, F.floor(rank / (small + 1))).otherwise(
            n_large + F.floor((rank - border) / max(small, 1))
        )
        unset = sdb.filter(number.isNull()).withColumn(attr, F.lit(None).cast("string"))
        return ranked.withColumn(attr, group.cast("string")).select(sdb.columns).unionByName(unset)
    shares = [i / n for i in range(1, n)]
    # n - 1 numbers
    cuts = sdb.agg(F.percentile_approx(number, shares, accuracy)).first()[0] or []
    below = [F.when(number > c, 1).otherwise(0) for c in cuts]
    group = sum(below, F.lit(0))
    return sdb.withColumn(attr, F.when(number.isNotNull(), group.cast("string")))


def map_values(sdb: DataFrame, attr: str, mapping: DataFrame | dict[str, str]) -> DataFrame:
    """Generalise values by a lookup ``(val, mapped)``; other values stay.

    Of several rows for one value the smallest ``mapped`` counts, so no event is doubled.
    """
    if isinstance(mapping, dict):
        mapping = sdb.sparkSession.createDataFrame(
            list(mapping.items()), "val string, mapped string"
        )
    lookup = mapping.groupBy(F.col("val").alias("_val")).agg(F.min("mapped").alias("_mapped"))
    lookup = broadcast_if_small(lookup, lookup.count())
    joined = sdb.join(lookup, F.col(attr) == F.col("_val"), "left")
    return joined.withColumn(attr, F.coalesce("_mapped", attr)).drop("_val", "_mapped")


def explode_attribute(
    sdb: DataFrame, attr: str, values: list[str] | None = None, max_values: int = 1000
) -> DataFrame:
    """Replace an attribute by one attribute per value, in its place.

    A column per value has to be part of the schema: ``values`` names those wanted, others
    become unset.  Without it all values are looked up; more than ``max_values`` are an error.
    """
    if values is None:
        found = sdb.filter(F.col(attr).isNotNull()).select(attr).distinct().limit(max_values + 1).collect()
        if len(found) > max_values:
            raise ValueError(f"{attr} has more than {max_values} values: name those wanted, or bin or map them first")
        values = [r[0] for r in found]
    columns = []
    for a in attributes(sdb):
        if a == attr:
            columns += [F.when(F.col(a) == v, F.col(a)) for v in sorted(values)]
        else:
            columns.append(F.col(a))
    return sdb.select("stream_id", "pos", *[c.alias(f"a{i}") for i, c in enumerate(columns)])
