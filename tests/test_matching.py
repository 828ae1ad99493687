"""Matching: earliest ends, windows, witnesses, instances, containment."""

from __future__ import annotations

import random
from decimal import Decimal

import brute
import pytest
from pyspark.sql import functions as F

import streamquarry as sq
from streamquarry.operators import matching

NODES = {
    1: "1,schedule,low 1,kill,low 1,schedule,high 1,update,high",
    2: "2,schedule,low 3,schedule,high 2,evict,low",
    3: "4,schedule,high 5,schedule,low 4,finish,high 6,schedule,low 5,evict,low",
}


def read(text):
    def sym(s):
        return None if s == "" else int(s[2:]) if s.startswith("$x") else s

    return tuple(tuple(sym(s) for s in t.split(";")[:-1]) for t in text.split())


def ends(df):
    return sorted((r.query_id, r.stream_id, tuple(r.b), r.p) for r in df.collect())


def expected(db, texts):
    out = []
    for i, text in enumerate(texts):
        for s, stream in db.items():
            best = {}
            for pos, bind in brute.matches(read(text), stream):
                key = tuple(bind[v] for v in sorted(bind))
                best[key] = min(best.get(key, 99), pos[-1])
            out += [(i + 1, s, k, p) for k, p in best.items()]
    return sorted(out)


TEXTS = ["$x0;;; ;;high; $x0;evict;;", ";schedule;; ;schedule;;", "$x0;$x1;; ;$x1;; $x0;;;", ";;low;"]


@pytest.mark.parametrize("size", [4096, 2])
def test_match_equals_the_definition(make_db, make_queries, size):
    df, db = make_db(NODES)
    found = matching._match(df, make_queries(*TEXTS), matching._Options(), None, size)
    assert ends(found) == expected(db, TEXTS)


def test_many_variables_and_substrings(make_db, make_queries):
    values = [f"v{i}" for i in range(11)]
    df, db = make_db({1: " ".join(values + values), 2: " ".join(values + values[::-1]), 3: "xa 11 a1"})
    query = " ".join(f"$x{i};" for i in list(range(11)) * 2)
    found = sq.support(df, make_queries(query, "a;", "1;", "xa; 11;")).collect()
    assert {r.query_id: r.n_streams for r in found} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_same_text_in_two_attributes(make_db, make_queries):
    df, _ = make_db({1: "a,b b,a", 2: "a,b c,b"})
    found = sq.match(df, make_queries("$x0;; $x0;;", ";$x0; ;$x0;"))
    assert ends(found) == [(2, 2, ("b",), 1)]


GAP_CASES = [
    ({"gaps": [[(1, 1)]]}, [2]), ({"gaps": [[(3, 3)]]}, [4]), ({"gaps": [[(0, 0)]]}, []),
    ({"gap_forbidden": [[["x"]]]}, []), ({"gap_forbidden": [[["y"]]]}, [2]),
    ({"span": [3]}, [2]), ({"span": [2]}, []),
    ({"gaps": [[(-1, -1), (0, -1), (0, 0)]]}, [4]),
]


@pytest.mark.parametrize("extra, want", GAP_CASES)
def test_windows(make_db, make_queries, extra, want):
    df, _ = make_db({1: "a x b y b"})
    found = sq.match(df, make_queries("a; b;", **extra))
    assert [r.p for r in found.collect()] == want


@pytest.mark.parametrize("extra, want", GAP_CASES[2:6])
def test_windows_in_chunks(make_db, make_queries, extra, want):
    df, _ = make_db({1: "a x b y b"})
    options = matching._Options(
        gaps="gaps" in extra, forbidden="gap_forbidden" in extra, span="span" in extra)
    found = matching._match(df, make_queries("a; b;", **extra), options, None, 2)
    assert sorted({r.p for r in found.collect()})[:1] == want


def test_dropped_term_keeps_its_event_in_the_window(make_db, make_queries):
    df, _ = make_db({1: "a x b", 2: "a b", 3: "a x x b"})
    # $x7 occurs once: it is dropped, the gap becomes 1..1
    found = sq.match(df, make_queries("a; $x7; b;", gaps=[[(0, 0), (0, 0)]]))
    assert [r.stream_id for r in found.collect()] == [1]


def test_empty_term_between_forbidden_values(make_db, make_queries):
    df, _ = make_db({1: "a x b", 2: "a b", 3: "a x y b", 4: "a y x b"})
    # a, any event, b; no x before the event, no y behind it
    found = sq.match(df, make_queries("a; $x7; b;", gap_forbidden=[[["x"], ["y"]]]))
    assert sorted(r.stream_id for r in found.collect()) == [1, 4]


def test_witness_and_instances(make_db, make_queries):
    df, db = make_db(NODES)
    qs = make_queries(*TEXTS[:3])
    got = sorted((r.query_id, r.stream_id, tuple(r.positions)) for r in sq.instances(df, qs).collect())
    want = sorted((i + 1, s, pos) for i, t in enumerate(TEXTS[:3]) for s, st in db.items()
                  for pos, _ in brute.matches(read(t), st))
    assert got == want
    first = {}
    for q, s, pos in want:
        first[q, s] = min(first.get((q, s), (99, ())), (pos[-1], pos))
    found = {(r.query_id, r.stream_id): (r.p, tuple(r.positions)) for r in sq.witness(df, qs).collect()}
    assert found == first


def test_support_update_and_matched(make_db, make_queries):
    df, _ = make_db(NODES)
    qs = make_queries(*TEXTS)
    start = sq.match(df.filter("stream_id < 3"), qs)
    full = {r.query_id: r.n_streams for r in sq.support(df.filter("stream_id <> 1"), qs).collect()}
    updated = sq.update_support(
        start, qs, 2, df.filter("stream_id = 3"), df.filter("stream_id = 1").select("stream_id"))
    assert {r.query_id: r.n_streams for r in updated.collect()} == full
    pairs = sq.matched_streams(df, qs).collect()
    assert len(pairs) == 11 and sum(r.query_id == 1 for r in pairs) == 2


def test_containment(make_queries):
    rng = random.Random(3)
    raw = set()
    while len(raw) < 25:
        q = brute.normal([[rng.choice([None, "a", "b", 0, 1]), rng.choice([None, None, "c", 2])]
                          for _ in range(rng.randint(1, 3))])
        if q:
            raw.add(q)
    queries = sorted(raw, key=brute.text)
    qs = make_queries(*[brute.text(q) for q in queries])
    got = {(r.weaker_id, r.stricter_id) for r in sq.weaker_than(qs, qs).collect()}
    assert got == {(i + 1, j + 1) for i, p in enumerate(queries) for j, q in enumerate(queries)
                   if brute.weaker(p, q)}
    # every one-step generalisation is weaker
    steps = sq.generalisations(qs).collect()
    text = {i + 1: q for i, q in enumerate(queries)}
    assert all(brute.weaker(read(r.qstr), text[r.query_id]) for r in steps)


def window_holds(stream, positions, gaps, forbidden, span):
    """Do these positions keep to the windows of a query?"""
    last = len(stream) - 1
    between = [positions[0], *(b - a - 1 for a, b in zip(positions, positions[1:])), last - positions[-1]]
    if gaps and not all(lo <= n and (hi < 0 or n <= hi) for n, (lo, hi) in zip(between, gaps)):
        return False
    if forbidden and any(
        v in forbidden[i] for i, (a, b) in enumerate(zip(positions, positions[1:]))
        for e in stream[a + 1 : b] for v in e if v is not None
    ):
        return False
    return not span or positions[-1] - positions[0] + 1 <= span


@pytest.mark.parametrize("seed", range(3))
def test_windows_everywhere(make_db, make_queries, seed):
    rng = random.Random(seed)
    text = {i: " ".join(",".join(rng.choice("abc") for _ in range(2)) for _ in range(rng.randint(2, 9))) for i in range(6)}
    df, streams = make_db(text)
    shapes = [("a;; b;;", [("a", None), ("b", None)]), ("$x0;; ;c; $x0;;", [(0, None), (None, "c"), (0, None)]),
              (";$x0; ;$x0;", [(None, 0), (None, 0)])]
    n = [len(q) for _, q in shapes]
    extra = {
        "gaps": [[(rng.randint(0, 1), rng.choice([-1, 2, 3])) for _ in range(k + 1)] for k in n],
        "gap_forbidden": [[rng.sample("abc", rng.randint(0, 1)) for _ in range(k - 1)] for k in n],
        "span": [rng.choice([-1, k + 1, k + 3]) for k in n],
    }
    for names in (["gaps"], ["gap_forbidden"], ["span"], ["gaps", "span"], ["gaps", "gap_forbidden", "span"]):
        own = {c: extra[c] for c in names}
        qs = make_queries(*[t for t, _ in shapes], **own)
        want = {}
        for q, (_, query) in enumerate(shapes):
            for s, events in streams.items():
                found = [pos for pos, _ in brute.matches(query, events) if window_holds(
                    events, pos, own.get("gaps", [None] * 3)[q], own.get("gap_forbidden", [None] * 3)[q],
                    max(0, own.get("span", [0] * 3)[q]))]
                if found:
                    want[q + 1, s] = found
        if seed == 0:
            counted = {(r.query_id, r.stream_id): int(r.n_instances) for r in sq.count_instances(df, qs).collect()}
            assert counted == {k: len(v) for k, v in want.items()}
        got = {}
        for r in sq.instances(df, qs).collect():
            got.setdefault((r.query_id, r.stream_id), []).append(tuple(r.positions))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        first = {(r.query_id, r.stream_id): (r.p, tuple(r.positions)) for r in sq.witness(df, qs).collect()}
        assert first == {k: min((pos[-1], pos) for pos in v) for k, v in want.items()}
        if seed == 1:  # chunks of two events
            found = matching._match(df, qs, matching._options_of(qs), None, 2)
            first = found.groupBy("query_id", "stream_id").agg(F.min("p").alias("p")).collect()
            assert {(r.query_id, r.stream_id): r.p for r in first} == {
                k: min(pos[-1] for pos in v) for k, v in want.items()}
        types = {(r.query_id, r.stream_id): r.p for r in sq.match_types(df, qs).collect()}
        assert types == {k: min(pos[-1] for pos in v) for k, v in want.items() if k[0] == 1}


def test_query_without_conditions_matches_every_stream(make_db, make_queries):
    df, _ = make_db({1: "a", 2: "a b", 3: "b b b"})
    qs = make_queries("$x0;", "$x1; $x2;", "b;")
    assert {r.query_id: r.n_streams for r in sq.support(df, qs).collect()} == {1: 3, 2: 3, 3: 2}
    qs = make_queries("$x0;", "$x0; $x1;", gaps=[[(0, -1), (0, 1)], [(0, -1), (0, 0), (1, -1)]])
    assert {r.query_id: r.n_streams for r in sq.support(df, qs).collect()} == {1: 3, 2: 1}


def test_lookup_with_two_rows_for_a_value(make_db, spark):
    df, _ = make_db({1: "a b a"})
    mapping = spark.createDataFrame([("a", "q"), ("a", "p"), ("c", "z")], "val string, mapped string")
    assert [r.a0 for r in sq.map_values(df, "a0", mapping).orderBy("pos").collect()] == ["p", "b", "p"]


def test_generalisations_of_many_equal_symbols(make_queries):
    qs = make_queries(" ".join(["a;"] * 14))
    assert sq.generalisations(qs).count() > 500


def test_queries_that_begin_alike_share_nodes(make_db, make_queries):
    df, db = make_db({1: "a,x b,y a,x c,y", 2: "a,y c,y b,x a,y"})
    texts = ["a;; b;;", "a;; b;; a;;", "a;;", "a;; c;;", "$x0;; $x0;;", "a;; b;;", ";$x0; b;; ;$x0;"]
    qs = make_queries(*texts)
    nodes = {r.query_id: r.nodes for r in matching._prepare(qs, matching._Options()).collect()}
    assert nodes == {1: [1, 1], 2: [1, 1, 2], 3: [1], 4: [1, 4], 5: [5, 5], 6: [1, 1], 7: [7, 7, 7]}
    assert ends(sq.match(df, qs)) == expected(db, texts)
    spans = matching._prepare(make_queries("a;; b;;", "a;; c;;", span=[2, 3]), matching._Options(span=True))
    assert {r.query_id: r.nodes for r in spans.collect()} == {1: [1, 1], 2: [2, 2]}


def asked_rows(spark, ends, **columns):
    rows = [{"query_id": 1, "stream_id": 1, "b": ["v"], "p": p, "_from": p + 1, **columns} for p in ends]
    return spark.createDataFrame(
        [{**r, "_to": r["p"] + 1 + r["hi"] if r.get("hi") is not None else None, "p_first": r["p"]} for r in rows],
        "query_id long, stream_id long, b array<string>, p int, hi int, span int, _from int, _to int, p_first int, n decimal(38,0)")


def test_reach_of_many_ends_is_few_intervals(spark):
    options = matching._Options(gaps=True)
    got = matching._reach(asked_rows(spark, [*range(100), 200], hi=5), options, 4096).collect()
    assert sorted((r._from, r._to) for r in got) == [(1, 105), (201, 206)]
    # with a span each event behind the ends lies in one interval
    options = matching._Options(span=True)
    got = matching._reach(asked_rows(spark, range(100), span=10), options, 4096).collect()
    assert all(sum(r._from <= pos <= r._to for r in got) == 1 for pos in range(1, 108))
    options = matching._Options(counting=True)
    got = matching._reach(asked_rows(spark, range(100), n=Decimal(1)), options, 4096).collect()
    assert all([int(r.n) for r in got if r._from <= pos and (r._to is None or pos <= r._to)] == [min(pos, 100)]
               for pos in range(1, 150))


def test_number_of_instances_of_one_long_stream(make_db, make_queries):
    df, _ = make_db({1: " ".join(["a"] * 40)})
    qs = make_queries("a; a; a; a; a;", "a; b;", "$x0; $x0;", "$x0;")
    assert {r.query_id: int(r.n_instances) for r in sq.count_instances(df, qs).collect()} == {1: 658008, 3: 780, 4: 1}
    small = matching._match(df, qs, matching._Options(counting=True), None, 8).groupBy("query_id").agg(F.sum("n").alias("n"))
    assert {r.query_id: int(r.n) for r in small.collect()} == {1: 658008, 3: 780, 4: 1}
