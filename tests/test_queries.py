"""Tables of queries, and the registered queries against their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import check
import streamquarry as sq

FOLDER = "/root/testdata/sf0.001"


def test_notation_survives_reserved_characters(spark):
    odd = ["4-NOT SPECIFIED", "50%;x", "$x1", "plain"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "query_id bigint, v string")
    terms = df.withColumn("terms", F.expr(
        "array(array(named_struct('kind', 'val', 'val', v), named_struct('kind', 'any', 'val', CAST(NULL AS STRING))))"))
    again = sq.queries_from_strings(sq.to_strings(terms)).orderBy("query_id").collect()
    assert [r.terms[0][0].val for r in again] == odd
    assert all(r.terms[0][0].kind == "val" and r.terms[0][1].kind == "any" for r in again)


def test_normal_form_and_validation(make_queries):
    qs = make_queries("$x3;s; ;low; $x3;; $x9;;", "$x1; a; $x0; $x0;", "$x4;;")
    assert [r.qstr for r in sq.normal_form(qs).orderBy("query_id").collect()] == [
        "$x0;s; ;low; $x0;;", "a; $x0; $x0;", ""]
    bad = make_queries(
        "a;$x0; $x0;b;", "a; b;", "a; $x0;",
        gaps=[None, [(2, 1)], [(1, 2)]], span=[None, 1, 5],
    )
    errors = {r.query_id: r.errors for r in sq.validate_queries(bad).collect()}
    assert errors == {
        1: ["variable_in_two_attributes"],
        2: ["gap_bounds", "span_shorter_than_query"],
        3: ["gap_lower_bound_needs_normal_form", "span_and_normal_form"],
    }


def test_duplicates_ignore_window_placeholders(make_queries):
    qs = make_queries("a; b;", "a; b;", "a; b;", gaps=[[(0, 2)], [(-1, -1), (0, 2), (-1, -1)], [(0, 3)]])
    assert sorted(r.query_id for r in sq.dedupe_queries(qs).collect()) == [1, 3]


def test_generalisation_steps(make_queries):
    found = sq.generalisations(make_queries("a; a; $x0; $x0; $x0; $x0;")).collect()
    assert {r.qstr for r in found} == {
        "a; $x0; $x0; $x0; $x0;", "$x0; $x0; $x1; $x1; $x1; $x1;", "a; a; $x0; $x0; $x0;",
        "a; a; $x0; $x0; $x1; $x1;", "a; a; $x0; $x1; $x0; $x1;", "a; a; $x0; $x1; $x1; $x0;",
    }


SQL = entry_points.oracle_sql()
# these run the discovery engine, which test_discovery compares with brute force
DISCOVERY = ("discover_", "descriptive", "supported_queries", "weaker_than", "query_lattice",
             "classify_queries", "compare_query_sets")
FAST = [n for n in SQL if not n.startswith(DISCOVERY)]


def test_names_match():
    assert set(SQL) <= set(entry_points.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_registered_query(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.rows(df.columns, df.collect()) == check.rows(columns, result.fetchall())
