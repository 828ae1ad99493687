"""Sources, shaping, abstraction, profiling, also with hot keys split."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

import streamquarry as sq
from streamquarry.plans.chunks import keep_streams, overlapping_chunks
from streamquarry.plans.numbering import number_rows
from streamquarry.plans.spans import join_spans, value_spans
from streamquarry.functions.columns import cells


def events_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_traces(spark, tmp_path):
    lines = ["1;sch;low; 1;;low; \r", "2;kill;high;\t", "3;sch;low; 4;evict;;"]
    for i in range(2):
        with gzip.open(tmp_path / f"t{i}.txt.gz", "wt", newline="\n") as f:
            f.write("\n".join(lines))
    df = sq.read_traces(spark, str(tmp_path))
    assert df.columns == ["stream_id", "pos", "a0", "a1", "a2"]
    ids = sorted(r.stream_id.rsplit("/", 1)[1] for r in df.select("stream_id").distinct().collect())
    assert ids == [f"t{i}.txt.gz:{n}" for i in range(2) for n in range(3)]
    one = df.filter(F.col("stream_id").endswith("t0.txt.gz:0")).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in one] == [(0, "1", "sch", "low"), (1, "1", None, "low")]


def test_lines_of_split_files_are_numbered_once(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(f"{i};" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = sq.read_traces(spark, str(tmp_path / "t.txt"), 1)
        assert df.rdd.getNumPartitions() >= 1
        rows = df.select(F.element_at(F.split("stream_id", ":"), -1).cast("int").alias("n"), "a0").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2000 and all(str(r.n) == r.a0 for r in rows)


def test_store_and_reload(spark, make_db, tmp_path):
    df, _ = make_db({1: "a,1 b,-", 2: "c,3"})
    sq.write_streams(df, str(tmp_path / "s"))
    assert events_of(sq.read_streams(spark, str(tmp_path / "s"))) == events_of(df)


@pytest.mark.parametrize("hot_rows", [None, 5, 1000])
def test_numbering_of_hot_keys(spark, hot_rows):
    rows = [(1 if i % 3 else i, (i * 37) % 101) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, o int")
    got = {(r.k, r.o): r.pos for r in number_rows(df, ["k"], ["o"], "pos", hot_rows).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= {(k, o): i for i, o in enumerate(sorted(o for kk, o in rows if kk == k))}
    assert got == want
    everything = number_rows(df, [], ["o"], "pos", hot_rows).collect()
    assert sorted((r.pos, r.o) for r in everything) == list(enumerate(sorted(o for _, o in rows)))


def test_streams_before_match_overlap(spark):
    rows = [("u", i, c) for i, c in enumerate("abSaSb")] + [("v", 0, "S")]
    df = spark.createDataFrame(rows, "k string, t int, c string")
    seed = F.col("c") == "S"
    got = events_of(sq.streams_before_match(df, "k", ["t"], ["c"], seed, 3))
    want = [("a", 0), ("b", 1)], [("b", 0), ("S", 1), ("a", 2)]
    assert got == [(s, pos, c) for s, events in zip(("u:2", "u:4"), want, strict=True) for c, pos in events]
    every = sq.streams_before_match(df, "k", ["t"], ["c"], seed, 3, max_matches=None, hot_rows=2)
    assert events_of(every) == got
    numbered = sq.streams_before_match(df, "k", ["t"], ["c"], seed, 3, max_matches=1)
    assert events_of(numbered) == [(0, 0, "a"), (0, 1, "b")]


def test_shaping(make_db):
    df, _ = make_db({1: "a b c d", 2: "a b", 3: "c"})
    assert events_of(sq.keep_last(df, 2)) == [
        (1, 0, "c"), (1, 1, "d"), (2, 0, "a"), (2, 1, "b"), (3, 0, "c")]
    assert {r[0] for r in events_of(sq.drop_longer_than(df, 2))} == {2, 3}
    assert {r[0] for r in events_of(sq.require_values(df, ["a", "c"]))} == {1}
    assert {r[0] for r in events_of(sq.limit_streams(df, 2))} == {1, 2}


def test_chunked_joins_keep_long_streams_whole(make_db):
    df, db = make_db({1: "a b a b a b a", 2: "a", 3: "b b"})
    ids = df.filter("a0 = 'a'").groupBy("stream_id").agg(F.lit(6).alias("last_pos"))
    assert events_of(keep_streams(df, ids, size=2)) == events_of(df.filter("stream_id <> 3"))
    found = cells(df)
    spans = value_spans(found)
    joined = join_spans(found, spans, size=2)
    assert joined.count() == found.count()
    assert {(r.val, r.n) for r in joined.filter("stream_id = 1").collect()} == {("a", 4), ("b", 3)}
    rows = overlapping_chunks(df, 2, 3).filter("stream_id = 1").collect()
    chunks = {}
    for r in rows:
        chunks.setdefault(r["_chunk"], []).append(r.pos)
    assert {c: sorted(p) for c, p in chunks.items()} == {0: [0, 1, 2, 3, 4], 1: [3, 4, 5, 6], 2: [6]}


def test_abstraction(make_db):
    df, _ = make_db({1: "1,low 2,low 3,high", 2: "4,low 9,-"})
    assert [r.a0 for r in sq.bin_values(df, "a0", 2, exact=True, hot_rows=1).orderBy("stream_id", "pos").collect()] \
        == ["0", "0", "0", "1", "1"]
    unique = sq.uniquify_frequent(df, ["a1"], hot_rows=1).orderBy("stream_id", "pos").collect()
    assert [r.a1 for r in unique] == ["low", "low", "high", "low", None]
    more, _ = make_db({1: "a a a b c d", 2: "a a"})
    got = [r.a0 for r in sq.uniquify_frequent(more, hot_rows=1).orderBy("stream_id", "pos").collect()]
    assert got == ["a,0", "a,1", "a,2", "b", "c", "d", "a,3", "a,4"]
    wide = sq.explode_attribute(df, "a1")
    assert wide.columns[2:] == ["a0", "a1", "a2"]
    assert [(r.a1, r.a2) for r in wide.filter("stream_id = 1").orderBy("pos").collect()] == [
        (None, "low"), (None, "low"), ("high", None)]
    with pytest.raises(ValueError, match="more than 1 values"):
        sq.explode_attribute(df, "a1", max_values=1)


def test_chosen_streams(spark, make_db, make_queries):
    """Chosen streams keep all their events, whatever their chunks; others none."""
    from streamquarry.plans.chunks import chosen_streams

    df, _ = make_db({1: "a b a b a", 2: "a a", 3: "b"})
    some = spark.createDataFrame([(1,), (1,), (3,), (7,)], "stream_id bigint")
    for size in (2, 4096):
        kept = chosen_streams(df, some, size)
        assert sorted((r.stream_id, r.pos, r.a0) for r in kept.collect()) == [
            (1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (3, 0, "b")]
    found = sq.instances(df, make_queries("a; a;"), streams=some).collect()
    assert sorted(tuple(r.positions) for r in found) == [(0, 2), (0, 4), (2, 4)]
    index = sq.vertical_index(df, streams=some).collect()
    assert sorted((r.stream_id, r.val, r.positions) for r in index) == [
        (1, "a", [0, 2, 4]), (1, "b", [1, 3]), (3, "b", [0])]


def test_profile_of_the_worked_example(make_db):
    df, _ = make_db({
        1: "1,schedule,low 1,kill,low 1,schedule,high 1,update,high",
        2: "2,schedule,low 3,schedule,high 2,evict,low",
        3: "4,schedule,high 5,schedule,low 4,finish,high 6,schedule,low 5,evict,low",
    })
    row = sq.database_profile(df).first()
    assert (row.n_streams, row.n_attrs, row.n_supported, row.rho_s, row.rho_r) == (3, 3, 3, 8, 6)
    assert {(r.attr, r.val) for r in sq.supported_alphabet(df).collect()} == {
        (1, "schedule"), (2, "low"), (2, "high")}


def test_ngrams_overlap(make_db):
    df, _ = make_db({1: "a a a", 2: "b,1 -,2"})
    grams = {r.gram: r.n for r in sq.ngram_distribution(df, 2, "event").collect()}
    assert grams == {"a;; a;;": 2, "b;1; ;2;": 1}
    values = {r.gram: r.n for r in sq.ngram_distribution(df, 2, "attribute", hot_rows=2).collect()}
    assert values == {"a; a;": 2, "b; 1;": 1, "1; 2;": 1}
