"""The queries this repository registers, one or more per operator.

Each reads the whole parquet tables of a folder and works on whole streams:
``events``  all events of a user: event type and a bucket of the value;
``orders``  all orders of a customer: status and priority;
``talks``  all turns of a conversation: role and a bucket of the length.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import streamquarry as sq
from streamquarry.functions.notation import encode_value
from streamquarry.plans.workspace import shared_dir

BUCKET = "CAST(CAST(floor(value / 50) AS BIGINT) AS STRING)"
SUPP = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_streams(spark: SparkSession, sf_dir: str, attrs: tuple[str, ...] = ("event_type", BUCKET)) -> DataFrame:
    return sq.streams_from_table(
        table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"],
        [F.expr(a) for a in attrs],
    )


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_streams(spark, sf_dir, ("event_type",))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.streams_from_table(
        table(spark, sf_dir, "conversations"), "conv_id", ["turn"],
        ["role", F.expr("CASE WHEN length(text) < 300 THEN 'short' ELSE 'long' END")],
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.streams_from_table(
        table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"],
        ["o_orderstatus", "o_orderpriority"],
    )


def query_table(spark: SparkSession, *texts: str, extra: dict[str, list] | None = None) -> DataFrame:
    """Query parameters as a table, ids from 1."""
    extra = extra or {}
    types = {
        "gaps": "array<struct<lo:int,hi:int>>", "gap_forbidden": "array<array<string>>", "span": "int",
    }
    rows = [(i + 1, t, *[extra[c][i] for c in extra]) for i, t in enumerate(texts)]
    schema = ", ".join(["query_id bigint", "qstr string", *[f"{c} {types[c]}" for c in extra]])
    return sq.queries_from_strings(spark.createDataFrame(rows, schema))


# Query parameters used in several places.
TYPE_QUERIES = ("click;;", "click;; error;;", "click;0; view;;")
MIXED_QUERIES = ("$x0;; $x0;; $x0;;", "click;; $x0;; $x0;;", ";$x0; error;; ;$x0;", "$x0;$x1; $x0;$x1;")


def derived_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per stream, a term per event: types as oddly numbered variables, buckets as values."""
    streams = event_streams(spark, sf_dir)
    var = F.concat(F.lit("$x"), (F.ascii("a0") % 7 + 20).cast("string"))
    term = F.concat(var, F.lit(";"), F.when(F.col("pos") % 2 == 0, F.col("a1")).otherwise(""), F.lit(";"))
    return sq.queries_from_strings(
        streams.groupBy("stream_id").agg(
            F.array_join(F.transform(
                F.sort_array(F.collect_list(F.struct("pos", term.alias("t")))), lambda s: s["t"]
            ), " ").alias("qstr")
        ).select(F.col("stream_id").alias("query_id"), "qstr")
    )


def pair_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One type query per stream: the types of its first and its last event."""
    streams = event_types(spark, sf_dir)
    return sq.queries_from_strings(
        streams.groupBy("stream_id").agg(
            F.concat(F.min_by("a0", "pos"), F.lit("; "), F.max_by("a0", "pos"), F.lit(";")).alias("qstr")
        ).select(F.col("stream_id").alias("query_id"), "qstr")
    )


def order_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.project(orders(spark, sf_dir), ["a1"])


def whole_queries(streams: DataFrame) -> DataFrame:
    """Two queries per stream, a term per event: its values, and these with the first one as a variable."""
    first = streams.groupBy("stream_id").agg(F.min_by("a0", "pos").alias("first"))
    value = F.coalesce(encode_value(F.col("a0")), F.lit(""))
    term = F.struct(
        "pos", F.concat(value, F.lit(";")).alias("t"),
        F.when(F.col("a0") == F.col("first"), "$x0;").otherwise(F.concat(value, F.lit(";"))).alias("x"),
    )

    def text(part: str):
        return F.array_join(F.transform("events", lambda e: e[part]), " ")

    return sq.queries_from_strings(
        streams.join(first, "stream_id").groupBy("stream_id").agg(F.sort_array(F.collect_list(term)).alias("events"))
        .select("stream_id", F.posexplode(F.array(text("t"), text("x"))).alias("i", "qstr"))
        .select((2 * F.col("stream_id") + F.col("i")).alias("query_id"), "qstr")
    )


def exploded_terms(qs: DataFrame) -> DataFrame:
    return qs.select("query_id", F.posexplode("terms").alias("term", "t")).select(
        "query_id", "term", F.posexplode("t").alias("attr", "s")
    ).select("query_id", "term", "attr", "s.kind", F.coalesce("s.val", F.lit("")).alias("val"))


# -- sources and shaping ----------------------------------------------------


def q_read_traces(spark, sf_dir):
    path = f"{shared_dir(spark)}/traces-{uuid4().hex}"
    event = F.concat("a0", F.lit(";"), "a1", F.lit(";"))
    lines = event_streams(spark, sf_dir).groupBy("stream_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", event.alias("e")))), lambda s: s["e"]), " ").alias("line"))
    lines.select("line").write.option("compression", "gzip").text(path)
    return sq.read_traces(spark, path, n_attrs=2).groupBy("pos", "a0", "a1").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("stream_id").alias("n_streams")
    )


def q_write_read_streams(spark, sf_dir):
    path = f"{shared_dir(spark)}/streams-{uuid4().hex}"
    sq.write_streams(orders(spark, sf_dir), path)
    return sq.read_streams(spark, path)


def q_streams_before_match(spark, sf_dir):
    return sq.streams_before_match(
        table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", F.expr(BUCKET)],
        seed=F.expr("event_type = 'error' AND value > 40"), n_before=5,
    )


def q_streams_before_every_match(spark, sf_dir):
    return sq.streams_before_match(
        table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"],
        seed=F.expr("event_type = 'purchase'"), n_before=3,
    )


def q_streams_before_first_matches(spark, sf_dir):
    return sq.streams_before_match(
        table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"],
        seed=F.expr("event_type = 'error'"), n_before=4, max_matches=200,
    )


def q_split_attributes(spark, sf_dir):
    parts = sq.split_attributes(event_streams(spark, sf_dir))
    return parts["a0"].withColumn("attr", F.lit(0)).unionByName(
        parts["a1"].withColumn("attr", F.lit(1))
    ).select("stream_id", "pos", "attr", F.col("a0").alias("val"))


def q_uniquify_frequent(spark, sf_dir):
    return sq.uniquify_frequent(orders(spark, sf_dir))


def q_uniquify_by_position(spark, sf_dir):
    return sq.uniquify_frequent(event_streams(spark, sf_dir), ["a1"], exact=False)


def value_streams(spark, sf_dir):
    return event_streams(spark, sf_dir, ("event_type", "value"))


# -- matching ---------------------------------------------------------------


def q_match(spark, sf_dir):
    found = sq.match(event_streams(spark, sf_dir), query_table(spark, *MIXED_QUERIES))
    return found.select("query_id", "stream_id", F.array_join("b", ",").alias("b"), "p")


def q_gaps(spark, sf_dir):
    qs = query_table(spark, *GAP_QUERIES, extra={"gaps": GAPS})
    return sq.match(event_streams(spark, sf_dir), qs).select(
        "query_id", "stream_id", F.array_join("b", ",").alias("b"), "p")


def q_forbidden(spark, sf_dir):
    qs = query_table(
        spark, "click;; error;;", "$x0;; $x0;;",
        extra={"gap_forbidden": [[["view", "signup"]], [["error"]]]},
    )
    return sq.match(event_streams(spark, sf_dir), qs).select(
        "query_id", "stream_id", F.array_join("b", ",").alias("b"), "p")


def q_span(spark, sf_dir):
    qs = query_table(spark, "click;; error;;", "$x0;; view;; $x0;;", extra={"span": [3, 5]})
    return sq.match(event_streams(spark, sf_dir), qs).select(
        "query_id", "stream_id", F.array_join("b", ",").alias("b"), "p")


def q_witness(spark, sf_dir):
    found = sq.witness(event_streams(spark, sf_dir), query_table(spark, *MIXED_QUERIES[:3]))
    return found.select("query_id", "stream_id", "p", F.array_join("positions", ",").alias("positions"),
                        F.array_join("b", ",").alias("b"))


def q_instances(spark, sf_dir):
    found = sq.instances(event_streams(spark, sf_dir), query_table(spark, *MIXED_QUERIES[:3]))
    return found.select("query_id", "stream_id", F.array_join("positions", ",").alias("positions"),
                        F.array_join("b", ",").alias("b"))


def q_count_instances(spark, sf_dir):
    found = sq.count_instances(event_streams(spark, sf_dir), query_table(spark, *MIXED_QUERIES[:3]))
    return found.withColumn("n_instances", F.col("n_instances").cast("bigint"))


GAPS = [[(-1, -1), (1, 3), (-1, -1)], [(0, 9), (0, 4), (1, 30)], [(0, 1)]]
GAP_QUERIES = ("click;; error;;", "$x0;; $x0;;", ";0; ;1;")


def q_witness_with_gaps(spark, sf_dir):
    found = sq.witness(event_streams(spark, sf_dir), query_table(spark, *GAP_QUERIES, extra={"gaps": GAPS}))
    return found.select("query_id", "stream_id", "p", F.array_join("positions", ",").alias("positions"),
                        F.array_join("b", ",").alias("b"))


def q_witness_with_forbidden_values(spark, sf_dir):
    qs = query_table(spark, "click;; error;;", "$x0;; $x0;;", extra={"gap_forbidden": [[["view", "signup"]], [["error"]]]})
    found = sq.witness(event_streams(spark, sf_dir), qs)
    return found.select("query_id", "stream_id", "p", F.array_join("positions", ",").alias("positions"),
                        F.array_join("b", ",").alias("b"))


def q_instances_with_span(spark, sf_dir):
    qs = query_table(spark, "click;; error;;", "$x0;; view;; $x0;;", extra={"span": [3, 5]})
    return sq.instances(event_streams(spark, sf_dir), qs).select(
        "query_id", "stream_id", F.array_join("positions", ",").alias("positions"), F.array_join("b", ",").alias("b"))


def q_match_types_with_gaps(spark, sf_dir):
    qs = query_table(spark, GAP_QUERIES[0], GAP_QUERIES[2], extra={"gaps": [GAPS[0], GAPS[2]]})
    return sq.match_types(event_streams(spark, sf_dir), qs)


def q_support_of_empty_query(spark, sf_dir):
    return sq.support(event_streams(spark, sf_dir), query_table(spark, "$x0;;", ";$x1; ;$x2;", "click;; error;;"))


def q_streams_before_pair(spark, sf_dir):
    qs = query_table(spark, "error;; error;;", "$x0;; signup;; $x0;;", extra={"gaps": [[(0, 2)], [(0, 1), (0, 1)]]})
    return sq.streams_before_query(event_streams(spark, sf_dir), qs, 4)


def q_streams_before_span(spark, sf_dir):
    qs = query_table(spark, "click;; error;; view;;", extra={"span": [5]})
    return sq.streams_before_query(event_streams(spark, sf_dir), qs, 3)


def q_update_support(spark, sf_dir):
    streams = event_streams(spark, sf_dir)
    qs = query_table(spark, *MIXED_QUERIES)
    start = sq.match(streams.filter("stream_id % 3 <> 0"), qs)
    added, removed = streams.filter("stream_id % 3 = 0"), streams.filter("stream_id % 3 = 1").select("stream_id")
    n = sq.count_streams(streams.filter("stream_id % 3 <> 1"))
    return sq.update_support(start, qs, n, added, removed)


def q_classify(spark, sf_dir):
    streams = order_priorities(spark, sf_dir)
    reference = sq.discover(streams, SUPP)
    return sq.classify_queries(streams, whole_queries(streams), reference, SUPP)


# -- discovery --------------------------------------------------------------


def _strings(found, *more):
    return found.select("qstr", "n_terms", "kind", "n_streams", *more)


def _discover(strategy, inner="unified", attrs=("event_type", BUCKET)):
    def q(spark, sf_dir):
        return _strings(sq.discover(
            event_streams(spark, sf_dir, attrs), SUPP, max_terms=2, strategy=strategy, inner=inner,
            descriptive_only=False), "support", "descriptive")
    return q


def one_attribute_queries(spark, sf_dir):
    return sq.supported_queries(event_types(spark, sf_dir), SUPP, max_terms=2)


def q_compare(spark, sf_dir):
    streams = event_types(spark, sf_dir)
    return sq.compare_query_sets(
        sq.supported_queries(streams, 0.6, max_terms=2), sq.supported_queries(streams, 0.4, max_terms=2)
    )


def q_lattice(spark, sf_dir):
    return sq.query_lattice(one_attribute_queries(spark, sf_dir))


def q_weaker_than(spark, sf_dir):
    qs = one_attribute_queries(spark, sf_dir)
    pairs = sq.weaker_than(qs, qs)
    return (
        pairs.join(qs.select(F.col("query_id").alias("weaker_id"), F.col("qstr").alias("weaker")), "weaker_id")
        .join(qs.select(F.col("query_id").alias("stricter_id"), F.col("qstr").alias("stricter")), "stricter_id")
        .select("weaker", "stricter")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(streams, op):
        return lambda spark, sf_dir: op(streams(spark, sf_dir))

    return {
        # A
        "read_traces": q_read_traces,
        "write_read_streams": q_write_read_streams,
        "streams_from_table": orders,
        "streams_before_match": q_streams_before_match,
        "streams_before_every_match": q_streams_before_every_match,
        "streams_before_first_matches": q_streams_before_first_matches,
        "streams_before_query_pair": q_streams_before_pair,
        "streams_before_query_span": q_streams_before_span,
        "keep_last": on(orders, lambda s: sq.keep_last(s, 4)),
        "drop_longer_than": on(orders, lambda s: sq.drop_longer_than(s, 9)),
        "require_values": on(orders, lambda s: sq.require_values(s, ["F", "1-URGENT", "5-LOW"])),
        "limit_streams": on(orders, lambda s: sq.limit_streams(s, 50)),
        # B
        "project": on(orders, lambda s: sq.project(s, ["a1"])),
        "split_attributes": q_split_attributes,
        "uniquify_frequent": q_uniquify_frequent,
        "uniquify_by_position": q_uniquify_by_position,
        "mask_values": on(orders, lambda s: sq.mask_values(s, "a1", ["5-LOW", "4-NOT SPECIFIED"])),
        "mask_top_values": on(orders, lambda s: sq.mask_top_values(s, "a1", 2)),
        "bin_values": on(value_streams, lambda s: sq.bin_values(s, "a1", 4)),
        "bin_values_exact": on(value_streams, lambda s: sq.bin_values(s, "a1", 10, exact=True)),
        "map_values": on(orders, lambda s: sq.map_values(
            s, "a1", {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"})),
        "explode_attribute": on(orders, lambda s: sq.explode_attribute(s, "a0")),
        # C
        "stream_lengths": on(orders, sq.stream_lengths),
        "length_distribution": on(orders, sq.length_distribution),
        "alphabet": on(orders, sq.alphabet),
        "alphabet_global": on(event_streams, lambda s: sq.alphabet(s, per_attribute=False)),
        "supported_alphabet": on(event_streams, lambda s: sq.supported_alphabet(s, SUPP)),
        "vertical_index": on(event_streams, lambda s: sq.vertical_index(s).withColumn(
            "positions", F.array_join("positions", ","))),
        "value_distribution": on(orders, sq.value_distribution),
        "ngrams_of_events": on(orders, lambda s: sq.ngram_distribution(s, 2, "event")),
        "ngrams_of_values": on(event_streams, lambda s: sq.ngram_distribution(s, 3, "attribute")),
        "repeated_values": on(event_streams, sq.repeated_values),
        "database_profile": on(event_streams, lambda s: sq.database_profile(s, SUPP)),
        "type_pattern_disjointness": on(event_streams, lambda s: sq.type_pattern_disjointness(s, supp=0.75)),
        "disjointness_score": on(event_streams, lambda s: sq.disjointness_score(
            sq.type_pattern_disjointness(s, supp=0.75))),
        "value_presence": on(orders, sq.value_presence),
        "profile_report": on(orders, lambda s: sq.profile_report(s, 0.8, (2,))),
        # D
        "queries_from_strings": lambda spark, d: exploded_terms(derived_queries(spark, d)),
        "to_strings": lambda spark, d: sq.to_strings(derived_queries(spark, d).drop("qstr")).select(
            "query_id", "qstr"),
        "normal_form": lambda spark, d: sq.normal_form(derived_queries(spark, d)).select("query_id", "qstr"),
        "describe_queries": on(derived_queries, sq.describe_queries),
        "validate_queries": lambda spark, d: sq.validate_queries(
            derived_queries(spark, d).withColumn("gaps", F.expr(
                "transform(sequence(1, size(terms) - 1), i -> named_struct("
                "'lo', CAST(query_id % 3 AS INT), 'hi', CAST(query_id % 5 AS INT)))"))
            .withColumn("span", F.expr("CAST(query_id % 97 AS INT)"))
        ).select("query_id", F.array_join("errors", ",").alias("errors")),
        "dedupe_queries": lambda spark, d: sq.dedupe_queries(pair_queries(spark, d)).select("query_id", "qstr"),
        "generalisations": lambda spark, d: sq.generalisations(pair_queries(spark, d)).select("query_id", "qstr"),
        "weaker_than": q_weaker_than,
        # E
        "match_types": lambda spark, d: sq.match_types(
            event_streams(spark, d), query_table(spark, *TYPE_QUERIES)),
        "match": q_match,
        "support": lambda spark, d: sq.support(
            event_streams(spark, d), query_table(spark, *TYPE_QUERIES, *MIXED_QUERIES)),
        "supported": lambda spark, d: sq.supported(
            event_streams(spark, d), query_table(spark, *TYPE_QUERIES, *MIXED_QUERIES), SUPP),
        "matched_streams": lambda spark, d: sq.matched_streams(
            event_streams(spark, d), query_table(spark, *MIXED_QUERIES)),
        "match_with_forbidden_values": q_forbidden,
        "match_with_gaps": q_gaps,
        "match_with_span": q_span,
        "witness": q_witness,
        "instances": q_instances,
        "count_instances": q_count_instances,
        "witness_with_gaps": q_witness_with_gaps,
        "witness_with_forbidden_values": q_witness_with_forbidden_values,
        "instances_with_span": q_instances_with_span,
        "match_types_with_gaps": q_match_types_with_gaps,
        "support_of_empty_query": q_support_of_empty_query,
        "update_support": q_update_support,
        "supported_with_term_bound": lambda spark, d: sq.supported(
            event_streams(spark, d), query_table(spark, *TYPE_QUERIES, *MIXED_QUERIES), 0.2, max_terms=2),
        "classify_queries": q_classify,
        # F
        "discover_types": lambda spark, d: _strings(sq.discover_types(event_streams(spark, d), SUPP, max_terms=2)),
        "discover_types_prefix_span": lambda spark, d: _strings(
            sq.discover_types(event_types(spark, d), SUPP, max_items=2)),
        "discover_patterns": lambda spark, d: _strings(
            sq.discover_patterns(event_streams(spark, d), 0.2, max_terms=2)),
        "discover_unified": _discover("unified"),
        "discover_separated": _discover("separated"),
        "discover_by_attribute": _discover("by_attribute"),
        "discover_by_attribute_separated": _discover("by_attribute", "separated"),
        "discover_one_attribute": _discover("unified", attrs=("event_type",)),
        "discover_three_terms": lambda spark, d: _strings(sq.discover(talks(spark, d), 0.75, max_terms=3)),
        "discover_three_terms_supported": lambda spark, d: _strings(
            sq.supported_queries(talks(spark, d), 0.75, max_terms=3)),
        "discover_without_bound": lambda spark, d: _strings(sq.supported_queries(talks(spark, d), 0.75)),
        "supported_queries": lambda spark, d: _strings(one_attribute_queries(spark, d)),
        "descriptive": lambda spark, d: _strings(sq.descriptive(one_attribute_queries(spark, d))),
        "descriptive_by_generalisation": lambda spark, d: _strings(
            sq.descriptive(one_attribute_queries(spark, d), "generalisations")),
        "query_lattice": q_lattice,
        "discover_by_templates": lambda spark, d: _strings(
            sq.discover_by_templates(event_streams(spark, d), max_terms=2, supp=SUPP)),
        "discover_by_templates_lossy": lambda spark, d: _strings(
            sq.discover_by_templates(event_streams(spark, d), max_terms=2, supp=SUPP, lossy=True)),
        "discover_by_templates_three_terms": lambda spark, d: _strings(
            sq.discover_by_templates(talks(spark, d), max_terms=3, supp=0.75)),
        "query_lattice_frequent": lambda spark, d: sq.query_lattice(one_attribute_queries(spark, d), frequent_only=True),
        "compare_query_sets": q_compare,
    }
