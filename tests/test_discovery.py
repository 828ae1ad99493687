"""Discovery: worked examples, traps, brute force, agreement of the strategies."""

from __future__ import annotations

import itertools
import random

import brute
import pytest

import streamquarry as sq
from streamquarry.plans import growth, occurrences

NODES = {
    1: "1,schedule,low 1,kill,low 1,schedule,high 1,update,high",
    2: "2,schedule,low 3,schedule,high 2,evict,low",
    3: "4,schedule,high 5,schedule,low 4,finish,high 6,schedule,low 5,evict,low",
}
STRATEGIES = [("unified", "unified"), ("separated", "unified"), ("by_attribute", "unified"),
              ("by_attribute", "separated")]


def strings(df):
    return sorted(r.qstr for r in df.select("qstr").collect())


def counts(df):
    return {r.qstr: r.n_streams for r in df.select("qstr", "n_streams").collect()}


def test_worked_example(make_db):
    rows = sq.discover(make_db(NODES)[0], 1.0, descriptive_only=False).collect()
    kinds = [r.kind for r in rows]
    assert len(rows) == 38
    assert [kinds.count(k) for k in ("type", "pattern", "mixed")] == [14, 5, 19]
    assert sorted(r.qstr for r in rows if r.descriptive) == sorted([
        ";schedule;high;", "$x0;schedule;low; $x0;;low;",
        "$x0;schedule;low; ;schedule;; $x0;;;", "$x0;schedule;low; ;;high; $x0;;;",
    ])


@pytest.mark.parametrize("streams, supp, n, best", [
    ({1: "8 3 7", 2: "9 5 9"}, 1.0, 0, []),
    ({1: "h m h", 2: "h h m"}, 1.0, 5, ["h; h;", "h; m;"]),
    ({1: "a a b b", 2: "a a b b"}, 1.0, 14, ["a; a; b; b;"]),
    ({1: "a b a b", 2: "c d c d"}, 1.0, 2, ["$x0; $x1; $x0; $x1;"]),
    ({1: "a b c", 2: "a c b", 3: "b c a"}, 0.5, 6, ["a; b;", "a; c;", "b; c;"]),
    ({1: "a,1 b,1", 2: "a,2 b,2"}, 1.0, 7, ["a;$x0; b;$x0;"]),
    # unset attributes neither match nor bind
    ({1: "a,- b,1", 2: "a,2 b,-"}, 1.0, 3, ["a;; b;;"]),
])
def test_small_cases(make_db, streams, supp, n, best):
    df = sq.discover(make_db(streams)[0], supp, descriptive_only=False)
    rows = df.collect()
    assert len(rows) == n
    assert sorted(r.qstr for r in rows if r.descriptive) == best


def random_db(rng, n_streams, n_events, values, n_attrs=2):
    return {
        s: " ".join(
            ",".join(rng.choice([*values, "-"] if a else values) for a in range(n_attrs))
            for _ in range(rng.randint(max(1, n_events - 1), n_events))
        )
        for s in range(1, n_streams + 1)
    }


@pytest.mark.parametrize("seed, supp, n_events", [(1, 1.0, 4), (2, 0.5, 4)])
def test_against_brute_force(make_db, seed, supp, n_events):
    rng = random.Random(seed)
    df, db = make_db(random_db(rng, 3, n_events, ["p", "q", "xp"]))
    bound = min(3, brute.reached_length(db, supp))
    want = {brute.text(q): n for q, n in brute.discover(db, supp, bound).items()}
    best = sorted(brute.text(q) for q in brute.descriptive(brute.discover(db, supp, bound)))
    found = sq.discover(df, supp, bound, descriptive_only=False).collect()
    assert {r.qstr: r.n_streams for r in found} == want
    assert sorted(r.qstr for r in found if r.descriptive) == best


@pytest.mark.parametrize("strategy, inner", STRATEGIES[1:])
def test_strategies_agree(make_db, strategy, inner):
    df, db = make_db(random_db(random.Random(7), 3, 4, ["p", "q"]))
    bound = 3 if inner == "unified" else 2
    want = {brute.text(q): n for q, n in brute.discover(db, 0.6, bound).items()}
    assert counts(sq.supported_queries(df, 0.6, bound, strategy, inner)) == want


def test_long_streams_use_many_chunks(make_db, monkeypatch):
    df, db = make_db(random_db(random.Random(11), 2, 5, ["p", "q"], 1) | {9: "p q p q p q p"})
    monkeypatch.setattr(occurrences, "INDEX_CHUNK", 2)
    monkeypatch.setattr(growth, "INDEX_CHUNK", 2)
    want = {brute.text(q): n for q, n in brute.discover(db, 0.6, 3).items()}
    assert counts(sq.supported_queries(df, 0.6, 3)) == want


def test_types_patterns_and_lossy_templates(make_db):
    df, db = make_db(random_db(random.Random(5), 3, 4, ["p", "q"]))
    everything = brute.discover(db, 0.6, 2)
    only = lambda keep: {brute.text(q): n for q, n in everything.items() if keep(q)}
    symbols = lambda q: [s for t in q for s in t if s is not None]
    assert counts(sq.discover_types(df, 0.6, 2)) == only(
        lambda q: all(isinstance(s, str) for s in symbols(q)))
    assert counts(sq.discover_patterns(df, 0.6, 2)) == only(
        lambda q: all(isinstance(s, int) for s in symbols(q)))
    lossy = sq.discover_by_templates(df, 2, lossy=True, supp=0.6, descriptive_only=False)
    assert counts(lossy) == only(lambda q: all(any(isinstance(s, str) for s in t) for t in q))


@pytest.mark.parametrize("seed, supp, max_terms", [(3, 0.5, 3), (7, 1.0, 2)])
def test_templates_against_brute_force(make_db, seed, supp, max_terms):
    """Open terms, constraints across terms and sets of several constraints."""
    df, db = make_db(random_db(random.Random(seed), 2, 5, ["p", "q"]))
    found = sq.discover_by_templates(df, max_terms, supp=supp, descriptive_only=False)
    assert counts(found) == {brute.text(q): n for q, n in brute.discover(db, supp, max_terms).items()}
    assert strings(sq.discover_by_templates(df, max_terms, supp=supp)) == strings(sq.discover(df, supp, max_terms))


def test_templates_of_worked_example(make_db):
    rows = sq.discover_by_templates(make_db(NODES)[0], descriptive_only=False).collect()
    assert len(rows) == len({r.query_id for r in rows}) == len({r.qstr for r in rows}) == 38
    assert sum(r.descriptive for r in rows) == 4


def test_templates_of_long_and_empty_streams(make_db):
    """Places of a template in several chunks; constraints of four places; nothing to find."""
    texts = "a b c a b d a b a b", "b a b a c d d a b b a a b"
    df, _ = make_db(dict(enumerate(texts)))
    common = set.intersection(*(
        {" ".join(e + ";" for e in c) for k in range(1, 11) for c in itertools.combinations(t.split(), k)}
        for t in texts
    ))
    for chunk in (4096, 2):
        assert {r.terms: r.n_streams for r in _template_sequences(df, chunk)} == dict.fromkeys(common, 2)
    df, _ = make_db({1: "a b a b", 2: "c d c d"})
    assert strings(sq.discover_by_templates(df, descriptive_only=False)) == [
        "$x0; $x0;", "$x0; $x1; $x0; $x1;"]
    assert sq.discover_by_templates(df, lossy=True).count() == 0
    assert sq.discover_by_templates(df.limit(0)).count() == sq.discover_types(df.limit(0)).count() == 0


def _template_sequences(df, chunk):
    from streamquarry.functions import notation as nt
    from streamquarry.operators.templates import TemplateMining

    with TemplateMining(df, 1.0, chunk=chunk) as mining:
        return mining.sequences().select(nt.format_terms("terms").alias("terms"), "n_streams").collect()


def test_prefix_span_gives_the_same_types(make_db):
    df, db = make_db(NODES)
    want = {brute.text(q): n for q, n in brute.discover(db, 1.0, 2).items()
            if all(isinstance(s, str) for t in q for s in t if s is not None)
            and sum(s is not None for t in q for s in t) <= 2}
    assert counts(sq.discover_types(df, 1.0, max_items=2)) == want


def test_lattice_and_comparison(make_db):
    df, _ = make_db({1: "a a b", 2: "a a b"})
    qs = sq.supported_queries(df, 1.0)
    edges = {(r.child, r.parent, r.child_descriptive) for r in sq.query_lattice(qs).collect()}
    assert ("a; a; b;", "$x0; $x0; b;", True) in edges
    assert ("a; a;", "$x0; $x0;", False) in edges
    best = strings(sq.descriptive(qs, "generalisations"))
    assert best == strings(sq.descriptive(qs)) == ["a; a; b;"]
    row = sq.compare_query_sets(sq.descriptive(qs), qs).first()
    assert (row.true_positives, row.false_positives, row.misses) == (1, 0, qs.count() - 1)


@pytest.mark.parametrize("streams, supp", [
    (NODES, 0.6), ({1: "a a a b b", 2: "a b a b a", 3: "b b a a a"}, 0.6), ({1: "a b a b a b", 2: "c d c d c d"}, 1.0)])
def test_lattice_within_the_table(make_db, streams, supp):
    qs = sq.supported_queries(make_db(streams)[0], supp, 4)
    edges = lambda df: {tuple(r) for r in df.collect()}
    every = edges(sq.query_lattice(qs).filter("parent_n_streams IS NOT NULL"))
    inner = sq.query_lattice(qs, frequent_only=True)
    assert edges(inner) == every and inner.count() == len(every) > 1
    # also in a table that lacks queries
    some = qs.filter("n_terms > 1")
    assert edges(sq.query_lattice(some, frequent_only=True)) == edges(
        sq.query_lattice(some).filter("parent_n_streams IS NOT NULL"))


def test_lattice_of_many_equal_symbols(make_queries):
    """Forty equal symbols have 2^40 generalisations; the lattice of the table forms none of them."""
    qs = sq.to_strings(make_queries(" ".join(["a;"] * 40), " ".join(["a;"] * 39), " ".join(["a;"] * 38 + ["$x0;"] * 2), "a;"))
    qs = qs.withColumn("n_streams", qs.query_id)
    edges = [(r.child_n_streams, r.parent_n_streams, r.child_descriptive) for r in sq.query_lattice(qs, True).collect()]
    assert sorted(edges) == [(1, 2, True), (1, 3, True)]


def test_nodes_cover_intervals_once(spark):
    from pyspark.sql import functions as F

    from streamquarry.plans.chunks import chunk_levels, covering_nodes, nodes_of

    levels = chunk_levels(40, 1)
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a, 41, 2)]
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("n", covering_nodes(F.col("a"), F.col("b"), levels))
    at = {r.c: set(r.n) for r in spark.range(41).select(F.col("id").alias("c"), nodes_of(F.col("id"), levels).alias("n")).collect()}
    for r in df.collect():
        assert len(set(r.n)) == len(r.n) <= 2 * (levels + 1)
        assert all(len(at[c] & set(r.n)) == (r.a <= c <= r.b) for c in range(41))


@pytest.mark.parametrize("n", [1000, 4000])
def test_index_grows_with_the_events(spark, n):
    import random

    from streamquarry.plans.occurrences import build_index

    values = [str(i % (n // 2)) for i in range(n)]
    random.Random(n).shuffle(values)
    sdb = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "stream_id bigint, pos int, a0 string")
    assert build_index(sdb, 1, n - 1).rows.count() <= 12 * n


def test_written_levels_are_deleted(spark, make_db):
    import os

    df, _ = make_db({1: "a b a", 2: "b a a"})
    folder = spark.conf.get("spark.checkpoint.dir")
    before = {x for x in os.listdir(folder) if x.startswith("level") or x.startswith("streams") or x.startswith("values")}
    found = sq.discover(df, 1.0)
    after = {x for x in os.listdir(folder) if x.startswith("level") or x.startswith("streams") or x.startswith("values")}
    assert after == before and found.count() > 0


def test_ids_of_queries_do_not_depend_on_partitions(spark, make_db):
    df, _ = make_db({1: "a,x b,y a,x", 2: "b,y a,x a,x"})
    many = df.repartition(97)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = [r.query_id for r in sq.supported_queries(many, 1.0).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(ids)) == len(ids) and max(ids) < 100_000
    assert {r.qstr for r in sq.supported_queries(df, 1.0).collect()} == {r.qstr for r in sq.supported_queries(many, 1.0).collect()}
