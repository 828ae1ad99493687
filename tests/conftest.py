from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_db(spark):
    """Stream database from ``{id: "a,1 b,- ..."}``; ``-`` is an unset attribute."""

    def make(streams: dict[int, str]):
        parsed = {
            s: [tuple(None if v == "-" else v for v in e.split(",")) for e in text.split()]
            for s, text in streams.items()
        }
        n = max(len(e) for events in parsed.values() for e in events)
        schema = "stream_id bigint, pos int, " + ", ".join(f"a{i} string" for i in range(n))
        rows = [(s, i, *e, *[None] * (n - len(e))) for s, events in parsed.items() for i, e in enumerate(events)]
        return spark.createDataFrame(rows, schema), parsed

    return make


@pytest.fixture(scope="session")
def make_queries(spark):
    import streamquarry as sq

    def make(*texts: str, **extra):
        types = {"gaps": "array<struct<lo:int,hi:int>>", "gap_forbidden": "array<array<string>>",
                 "span": "int"}
        rows = [(i + 1, t, *[extra[c][i] for c in extra]) for i, t in enumerate(texts)]
        schema = ", ".join(["query_id bigint", "qstr string", *[f"{c} {types[c]}" for c in extra]])
        return sq.queries_from_strings(spark.createDataFrame(rows, schema))

    return make
