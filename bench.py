"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder with the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from check import session
from pyspark.sql import functions as F  # noqa: F401

import registered_queries as rq
import streamquarry as sq

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def discover(strategy: str, inner: str = "unified"):
    """Whole conversations, two attributes, no bound on the terms."""
    return lambda spark: sq.discover(rq.talks(spark, FOLDER), 0.75, strategy=strategy, inner=inner)


def registered(name: str):
    return lambda spark: rq.queries()[name](spark, FOLDER)


def main() -> None:
    headline = {
        "discover_unified": discover("unified"),
        "discover_separated": discover("separated"),
        "discover_by_attribute": discover("by_attribute"),
        "discover_by_attribute_separated": discover("by_attribute", "separated"),
        "discover_types": lambda spark: sq.discover_types(rq.event_streams(spark, FOLDER), 0.5, max_terms=2),
    } | {
        name: registered(name)
        for name in (
            "streams_from_table", "streams_before_match", "uniquify_frequent", "profile_report",
            "database_profile", "type_pattern_disjointness", "ngrams_of_values", "match", "support",
            "match_with_gaps", "instances_with_span", "generalisations", "discover_by_templates",
            "discover_by_templates_lossy", "count_instances",
        )
    }
    only = os.environ.get("BENCH_QUERIES")
    if only:
        headline = {k: v for k, v in headline.items() if k in only.split(",")}
    spark = session(CPUS)
    spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name, query in headline.items():
        start = time.time()
        query(spark).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
