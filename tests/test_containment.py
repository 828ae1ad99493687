"""Containment of queries against the definition, and the number of pairs that are tried."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

import streamquarry as sq
from streamquarry.plans.workspace import materialize
from streamquarry.operators.containment import (
    containment_candidates, neighbour_candidates, weaker_queries, weaker_than,
)


def random_queries(seed, n, n_attrs, letters, most_terms=5):
    rng = random.Random(seed)
    found = {()}  # the empty one too
    for _ in range(20 * n):
        symbols = [None, *letters, 0, 1, 2]
        q = brute.normal([tuple(rng.choice(symbols) for _ in range(n_attrs)) for _ in range(rng.randrange(1, most_terms + 1))])
        by_attr = {(s, a) for t in q for a, s in enumerate(t) if brute.is_var(s)}
        if len({s for s, _ in by_attr}) == len(by_attr):  # a variable belongs to one attribute
            found.add(q)
    return sorted(found, key=repr)[:n]


@pytest.mark.parametrize(("seed", "n_attrs", "letters"), [(2, 1, "ab"), (3, 2, "ab")])
def test_weaker_queries(make_queries, seed, n_attrs, letters):
    queries = random_queries(seed, 60, n_attrs, letters)
    blank = lambda q: brute.text(q) if q else ""
    qs = make_queries(*map(blank, queries)).withColumn(
        "terms", F.when(F.col("qstr") == "", F.array().cast("array<array<struct<kind:string,val:string>>>")).otherwise(F.col("terms")))
    qs = materialize(qs, "qs")
    want = {(i + 1, j + 1) for i, a in enumerate(queries) for j, b in enumerate(queries) if brute.weaker(a, b)}
    assert {(r.weaker_id, r.stricter_id) for r in weaker_than(qs, qs).collect()} == want
    flagged = {r.query_id for r in weaker_queries(qs).collect()}
    assert flagged == {a for a, _ in want}


def test_neighbours_decide_in_complete_tables(make_db):
    df, db = make_db({1: "a b a b a", 2: "c d c d c", 3: "a a b b a"})
    supp, bound = 0.6, 5
    found = sq.supported_queries(df, supp, bound)
    weaker = {r.query_id for r in weaker_queries(found, complete=True).collect()}
    texts = {r.qstr for r in found.collect() if r.query_id not in weaker}
    assert texts == {brute.text(q) for q in brute.descriptive(brute.discover(db, supp, bound))}
    assert weaker == {r.query_id for r in weaker_queries(found).collect()}


def test_candidates_grow_with_the_queries(make_db):
    """Streams of one pattern each, under names of their own: twice the patterns, twice the pairs."""
    counts = []
    for n in (5, 10):
        events = [" ".join(f"{c}{i}" for c in "abab") for i in range(n)]
        df, _ = make_db({2 * i + k: e for i, e in enumerate(events) for k in range(2)})
        found = sq.supported_queries(df, 1 / n, 4)
        counts.append((found.count(), neighbour_candidates(found).count(), containment_candidates(found, found).count()))
    for small, large in zip(counts, counts[1:], strict=False):
        for a, b in zip(small, large, strict=True):
            assert b <= 2.2 * a
    n_queries, near, contained = counts[-1]
    assert near < 8 * n_queries and contained < n_queries ** 2 / 8
