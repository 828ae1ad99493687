"""Profiles of a stream database: lengths, alphabets, distributions, difficulty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamquarry.functions.columns import attributes, cells, threshold
from streamquarry.functions.notation import encode_value
from streamquarry.plans.chunks import chosen_streams, chunk_of, overlapping_chunks
from streamquarry.plans.numbering import HOT_ROWS, number_rows
from streamquarry.plans.spans import join_spans, value_spans
from streamquarry.plans.workspace import broadcast_if_small



def _lengths(sdb: DataFrame) -> DataFrame:
    return sdb.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_events"))


def count_streams(sdb: DataFrame) -> int:
    """Number of streams; every stream has exactly one event at position 0."""
    return sdb.filter(F.col("pos") == 0).count()


def stream_lengths(sdb: DataFrame) -> DataFrame:
    """Number of streams, events, shortest, longest and mean length; ties by smallest id."""
    lengths = _lengths(sdb)
    shortest = F.min(F.struct("n_events", "stream_id"))
    longest = F.min(F.struct((-F.col("n_events")).alias("n_events"), F.col("stream_id")))
    return lengths.agg(
        F.count(F.lit(1)).alias("n_streams"),
        F.sum("n_events").alias("n_events"),
        shortest.alias("s"),
        longest.alias("l"),
        F.avg("n_events").alias("mean_length"),
    ).select(
        "n_streams", "n_events",
        F.col("s.n_events").alias("min_length"), F.col("s.stream_id").alias("min_stream"),
        (-F.col("l.n_events")).alias("max_length"), F.col("l.stream_id").alias("max_stream"),
        "mean_length",
    )


def _with_share(counts: DataFrame, n: str, by: list[str] | None = None) -> DataFrame:
    """Add ``share``: n divided by the sum of n (per ``by``), joined as a small total."""
    totals = counts.groupBy(*(by or [])).agg(F.sum(n).alias("_total"))
    if by:
        joined = counts.join(F.broadcast(totals), by)  # one row per attribute
    else:
        one = F.lit(1)
        joined = counts.withColumn("_one", one).join(
            F.broadcast(totals.withColumn("_one", one)), "_one"  # one row
        ).drop("_one")
    return joined.withColumn("share", F.col(n) / F.col("_total")).drop("_total")


def length_distribution(sdb: DataFrame) -> DataFrame:
    """``n_events, n_streams, share`` for each stream length."""
    return _with_share(
        _lengths(sdb).groupBy("n_events").agg(F.count(F.lit(1)).alias("n_streams")), "n_streams"
    )


def _attribute_cells(sdb: DataFrame, attr: str | None) -> DataFrame:
    found = cells(sdb.select("stream_id", "pos", attr) if attr else sdb)
    return found


def alphabet(sdb: DataFrame, attr: str | None = None, per_attribute: bool = True) -> DataFrame:
    """Distinct values as ``(attr, val)``, or ``val`` alone with ``per_attribute=False``."""
    found = _attribute_cells(sdb, attr)
    return found.select("attr", "val").distinct() if per_attribute else found.select("val").distinct()


def supported_alphabet(
    sdb: DataFrame,
    supp: float = 1.0,
    attr: str | None = None,
    per_attribute: bool = True,
    n_streams: int | None = None,
) -> DataFrame:
    """Values that occur in at least ``ceil(n_streams * supp)`` streams, with that count."""
    needed = threshold(count_streams(sdb) if n_streams is None else n_streams, supp)
    keys = ["attr", "val"] if per_attribute else ["val"]
    return (
        _attribute_cells(sdb, attr)
        .select("stream_id", *keys).distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_streams"))
        .filter(F.col("n_streams") >= needed)
    )


def vertical_index(
    sdb: DataFrame, per_attribute: bool = True, streams: DataFrame | None = None
) -> DataFrame:
    """Positions of each value per stream as sorted arrays, one row per block of positions.

    ``block`` counts blocks of 4096 positions, so a value that fills a long
    stream gives several arrays of bounded size instead of one huge one.
    """
    found = cells(sdb if streams is None else chosen_streams(sdb, streams))
    keys = ["attr", "val"] if per_attribute else ["val"]
    return found.groupBy("stream_id", *keys, chunk_of(F.col("pos")).alias("block")).agg(
        F.sort_array(F.collect_set("pos")).alias("positions")
    )


def value_distribution(
    sdb: DataFrame, attr: str | None = None, per_attribute: bool = True
) -> DataFrame:
    """Occurrences and relative frequency of each value, within its attribute or globally."""
    keys = ["attr", "val"] if per_attribute else ["val"]
    counts = _attribute_cells(sdb, attr).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _with_share(counts, "n", ["attr"] if per_attribute else None)


def ngram_distribution(
    sdb: DataFrame, n: int, unit: str = "event", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Occurrences and share of each factor of n consecutive events or attribute values.

    Long streams are cut into chunks that share n - 1 tokens with the next one,
    so every factor is seen exactly once and no window holds a whole stream.
    """
    if unit == "event":
        token = F.concat(
            *[F.concat(F.coalesce(encode_value(F.col(a)), F.lit("")), F.lit(";"))
              for a in attributes(sdb)]
        )
        tokens = sdb.select("stream_id", "pos", token.alias("token"))
    elif unit == "attribute":
        tokens = number_rows(
            cells(sdb).withColumnRenamed("pos", "_event"),
            ["stream_id"], ["_event", "attr"], "pos", hot_rows,
        ).select("stream_id", "pos", F.concat(encode_value(F.col("val")), F.lit(";")).alias("token"))
    else:
        raise ValueError("unit is 'event' or 'attribute'")
    window = Window.partitionBy("stream_id", "_chunk").orderBy("pos")
    grams = (
        overlapping_chunks(tokens, n - 1)
        .select(
            "_own", F.lead("token", n - 1).over(window).alias("_end"),
            F.concat_ws(" ", *[F.lead("token", i).over(window) for i in range(n)]).alias("gram"),
        )
        .filter(F.col("_own") & F.col("_end").isNotNull())
    )
    return _with_share(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "n")


def repeated_values(sdb: DataFrame) -> DataFrame:
    """``stream_id, attr, val, n`` of the values that occur at least twice in a stream."""
    return (
        value_spans(cells(sdb)).filter(F.col("n") >= 2).select("stream_id", "attr", "val", "n")
    )


def value_presence(sdb: DataFrame, n_streams: int | None = None) -> DataFrame:
    """Per value: streams that contain it, occurrences, the most in one stream, in all streams?"""
    total = count_streams(sdb) if n_streams is None else n_streams
    return (
        value_spans(cells(sdb))
        .groupBy("attr", "val")
        .agg(
            F.count(F.lit(1)).alias("n_streams"),
            F.sum("n").alias("n"),
            F.max("n").alias("max_in_stream"),
        )
        .withColumn("in_all", F.col("n_streams") == total)
    )


def database_profile(sdb: DataFrame, supp: float = 1.0) -> DataFrame:
    """One row of difficulty measures and the discovery strategy they favour.

    ``rho_s``: most occurrences of supported values in a stream; ``rho_r``:
    fewest occurrences of values repeated in their stream.  Many attributes or
    a large ``rho_s`` favour ``unified``, many supported values ``separated``,
    a large ``rho_r`` ``by_attribute``.
    """
    n_streams = count_streams(sdb)
    n_attrs = len(attributes(sdb))
    supported = supported_alphabet(sdb, supp, n_streams=n_streams)
    # every supported value needs ceil(n * supp) streams, so their number does
    # not grow with the database; the row count is checked all the same
    n_supported = supported.count()
    marked = broadcast_if_small(
        supported.select("attr", "val", F.lit(True).alias("_supported")), n_supported
    )
    per_stream = (
        value_spans(cells(sdb))
        .join(marked, ["attr", "val"], "left")
        .groupBy("stream_id")
        .agg(
            F.sum(F.when(F.col("_supported"), F.col("n")).otherwise(0)).alias("s"),
            F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("r"),
            F.count(F.lit(1)).alias("_values"),
        )
    )
    rho_s, rho_r = F.col("rho_s"), F.col("rho_r")
    return per_stream.agg(
        F.count(F.lit(1)).alias("_with_cells"),
        F.max("s").alias("rho_s"),
        F.min("r").alias("_r"),
    ).select(
        F.lit(n_streams).cast("bigint").alias("n_streams"),
        F.lit(n_attrs).alias("n_attrs"),
        F.lit(n_supported).cast("bigint").alias("n_supported"),
        F.coalesce("rho_s", F.lit(0)).alias("rho_s"),
        # a stream without any set value repeats nothing
        F.when(F.col("_with_cells") < n_streams, 0).otherwise(F.col("_r")).alias("rho_r"),
    ).withColumn(
        "strategy",
        F.when(rho_r > 2 * rho_s, "by_attribute")
        .when(F.col("n_supported") > 10 * F.col("n_attrs"), "separated")
        .otherwise("unified"),
    )


def type_pattern_disjointness(
    sdb: DataFrame, method: str = "advanced", supp: float = 1.0, per_attribute: bool = True
) -> DataFrame:
    """Per stream: how far supported values (T) and repeated values (P) lie apart, in [-1, 1].

    Cells are ordered by position and attribute.  T cells are counted before, in
    and behind the range of the P cells and the other way round.  Without P the
    result is 1, without T it is -1.
    """
    n_attrs = len(attributes(sdb))
    found = cells(sdb)
    spans = value_spans(found)
    supported = supported_alphabet(sdb, supp, per_attribute=per_attribute).drop("n_streams")
    marked = broadcast_if_small(
        supported.withColumn("_t", F.lit(True)), supported.count()
    )
    keys = ["attr", "val"] if per_attribute else ["val"]
    spans = (
        spans.join(marked, keys, "left")
        .select(
            "*", F.coalesce("_t", F.lit(False)).alias("t"), (F.col("n") >= 2).alias("p")
        )
        .drop("_t")
    )
    place = F.col("pos").cast("bigint") * n_attrs + F.col("attr")
    first = F.col("first_pos").cast("bigint") * n_attrs + F.col("attr")
    last = F.col("last_pos").cast("bigint") * n_attrs + F.col("attr")

    def only(flag: str, col: Column) -> Column:
        return F.when(F.col(flag), col)

    ranges = spans.groupBy("stream_id").agg(
        *[f(only(k, c)).alias(f"{k}_{name}") for k in ("t", "p")
          for f, c, name in ((F.min, first, "first"), (F.max, last, "last"))],
        F.max("last_pos").alias("_end"),
    )
    size_keys = ranges.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), chunk_of(F.col("_end"))))
    ).drop("_end")
    flagged = (
        join_spans(found, spans.drop("n"))
        .filter(F.col("t") | F.col("p"))
        .select("stream_id", place.alias("at"), "t", "p", chunk_of(F.col("pos")).alias("_chunk"))
    )

    def count(flag: str, where: Column) -> Column:
        return F.sum(F.when(F.col(flag) & F.coalesce(where, F.lit(False)), 1).otherwise(0))

    at = F.col("at")
    counts = flagged.join(size_keys, ["stream_id", "_chunk"]).groupBy("stream_id").agg(
        *[
            count(k, where).alias(f"{k}_{name}")
            for k, o in (("t", "p"), ("p", "t"))
            for name, where in (
                ("before", at < F.col(f"{o}_first")),
                ("in", at.between(F.col(f"{o}_first"), F.col(f"{o}_last"))),
                ("behind", at > F.col(f"{o}_last")),
            )
        ],
        F.sum(F.col("t").cast("int")).alias("n_t"),
        F.sum(F.col("p").cast("int")).alias("n_p"),
    )
    t_diff = (F.col("t_before") - F.col("t_behind")) / F.col("n_t")
    p_diff = (F.col("p_before") - F.col("p_behind")) / F.col("n_p")
    diff = t_diff - p_diff
    t_dev = F.abs(F.col("t_in") - F.col("n_t") / 2) / (F.col("n_t") / 2)
    p_dev = F.abs(F.col("p_in") - F.col("n_p") / 2) / (F.col("n_p") / 2)
    formulas = {
        "advanced": t_dev * p_dev * diff / 2,
        "default": F.when(diff == 0, 0.0).otherwise(t_dev * p_dev * F.pow(F.abs(diff / 2), 1 / 64)),
        "simple": F.signum(diff) * F.sqrt(t_dev) * F.sqrt(p_dev),
    }
    all_counts = [f"{k}_{name}" for k in ("t", "p") for name in ("before", "in", "behind")]
    ids = sdb.filter(F.col("pos") == 0).select("stream_id")
    n_t, n_p = F.coalesce("n_t", F.lit(0)), F.coalesce("n_p", F.lit(0))
    return ids.join(counts, "stream_id", "left").select(
        "stream_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in all_counts],
        F.when(n_p == 0, 1.0).when(n_t == 0, -1.0).otherwise(formulas[method])
        .alias("disjointness"),
    )


def disjointness_score(disjointness: DataFrame) -> DataFrame:
    """Half the distance between the largest and the smallest disjointness."""
    d = F.col("disjointness")
    return disjointness.agg(((F.max(d) - F.min(d)) / 2).alias("score"))


def profile_report(
    sdb: DataFrame, supp: float = 1.0, factors: tuple[int, ...] = (2,),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Lengths, alphabets and distributions as one table ``metric, key, value``."""
    def rows(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(metric).alias("metric"), key.cast("string").alias("key"),
            value.cast("double").alias("value"),
        )

    cell_key = F.concat_ws("=", "attr", "val")
    lengths = stream_lengths(sdb).select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
            for c in ("n_streams", "n_events", "min_length", "max_length", "mean_length")
        ]))
    )
    parts = [
        rows(lengths, "lengths", F.col("key"), F.col("value")),
        rows(length_distribution(sdb), "length_distribution", F.col("n_events"), F.col("share")),
        rows(alphabet(sdb).groupBy("attr").agg(F.count(F.lit(1)).alias("n")),
             "alphabet_size", F.col("attr"), F.col("n")),
        rows(supported_alphabet(sdb, supp), "supported_value", cell_key, F.col("n_streams")),
        rows(value_distribution(sdb), "value_distribution", cell_key, F.col("share")),
        rows(repeated_values(sdb).groupBy("attr").agg(F.count(F.lit(1)).alias("n")),
             "repeated_values", F.col("attr"), F.col("n")),
    ]
    parts += [
        rows(ngram_distribution(sdb, n, "event", hot_rows), f"ngram_{n}", F.col("gram"), F.col("share"))
        for n in factors
    ]
    return reduce(DataFrame.unionByName, parts)
