"""What must not grow with the streams: broadcasts, pairs of alike queries, work per symbol."""

from __future__ import annotations

import streamquarry as sq
from streamquarry.plans import workspace


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_steps_are_broadcast_by_rows_not_by_size_of_files(spark, monkeypatch):
    small = spark.range(3).selectExpr("id AS k").distinct()
    rows = spark.range(0, 5000, 1, 2).selectExpr("id % 7 AS k", "1 AS attr")
    assert "BroadcastHashJoin" in plan_of(workspace.materialize(rows).join(small, "k"))
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 1000)
    large = workspace.materialize(rows)
    assert "Broadcast" not in plan_of(large.filter("attr = 1").groupBy("k", "attr").count().join(small, "k"))
    asked = large.join(workspace.broadcast_if_small(small, 3), "k")
    assert "BroadcastHashJoin" in plan_of(asked)
    assert asked.count() == 2144
    assert workspace.materialize(rows.limit(0)).count() == 0


def test_results_stay_without_broadcasts(spark, make_db, monkeypatch):
    db, _ = make_db({1: "a,1 b,2 a,2", 2: "a,1 b,1 a,1", 3: "b,2 a,1 a,2"})
    queries = (sq.discover, sq.discover_by_templates)
    before = [q(db, supp=0.6, max_terms=2).select("qstr", "n_streams").collect() for q in queries]
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 0)
    after = [q(db, supp=0.6, max_terms=2).select("qstr", "n_streams").collect() for q in queries]
    assert [sorted(x) for x in before] == [sorted(x) for x in after]


def test_matches_of_streams_are_never_broadcast(spark, make_db, monkeypatch):
    from streamquarry.plans.growth import Growth

    db, _ = make_db({i: "a,1 b,2 a,2" if i % 2 else "a,1 b,1 a,1" for i in range(40)})
    plans, carried = [], Growth._carried
    monkeypatch.setattr(Growth, "_carried", lambda self, e: plans.append(plan_of(e)) or carried(self, e))
    for strategy in ("unified", "separated"):
        assert sq.supported_queries(db, 0.5, 2, strategy).count() > 0
    assert any("Union" in p for p in plans)
    # the one join of a level is that of matches and index; what is broadcast are tables of queries
    assert all("SortMergeJoin [stream_id" in p for p in plans)


def test_alike_queries_are_matched_once(spark, make_db, make_queries, monkeypatch):
    from streamquarry.operators import matching

    db, _ = make_db({1: "a,1 b,2 a,2", 2: "a,1 b,1 a,1", 3: "b,2 a,1 a,2"})
    asked = []
    inner = matching._match
    monkeypatch.setattr(matching, "_match", lambda s, qs, *rest: asked.append(qs.count()) or inner(s, qs, *rest))
    qs = make_queries(*["a;; b;;", "$x0;; $x0;;", "$x7;; $x7;; $x1;;", "a;; ;$x2; b;;"] * 5, "c;;", "b;; a;;")
    found = {r.query_id: r.n_streams for r in sq.support(db, qs).collect()}
    assert asked == [4]
    assert found == {i: [2, 3, 3, 2][(i - 1) % 4] for i in range(1, 21)} | {21: 0, 22: 3}
    windows = make_queries("a;; a;;", "a;; a;;", "a;; a;;", gaps=[[(0, 0)], [(0, 1)], [(0, 0)]])
    assert {r.query_id: r.n_streams for r in sq.support(db, windows).collect()} == {1: 1, 2: 3, 3: 1}


def test_normal_form_of_many_variables_in_time(spark, make_queries):
    import time

    n = 400  # x1, x4, ... occur again behind all others
    text = " ".join(f"$x{n - i};$y{i};" if i % 2 else f"$x{n - i};v;" for i in range(n))
    long = " ".join([text, *(f"$x{i};;" for i in range(1, n, 3))])
    start = time.time()
    (row,) = sq.normal_form(make_queries(long)).collect()
    assert time.time() - start < 20
    kept = [i for i in range(n) if (n - i) % 3 == 1 and n - i < n]
    names = {n - i: k for k, i in enumerate(kept)}
    want = [
        ";".join([f"$x{names[n - i]}" if n - i in names else "", f"$y{i}" if i % 2 else "v"]) + ";" for i in range(n)
    ] + [f"$x{names[i]};;" for i in range(1, n, 3)]
    assert row.qstr.replace("%24", "$") == " ".join(want)


def test_counts_left_out_of_the_filter_are_joined(spark, monkeypatch):
    from streamquarry.llm import ngram_filter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(ngram_filter, "BITS_PER_ENTRY", 256)  # next to no false positives
    scores = lambda: {r.doc_id: r.score for r in ngram_filter.score_texts(
        docs, ~ngram_filter.held_out("doc_id", 2, 7)).select("doc_id", "score").collect()}
    want, build = scores(), ngram_filter.build_filter

    def with_floor(counts, max_bits):
        held, bits_log2, least = build(counts.filter("n >= 4"), max_bits)
        assert least == 1
        return held, bits_log2, 4

    monkeypatch.setattr(ngram_filter, "build_filter", with_floor)
    got = scores()
    assert got.keys() == want.keys() and sum(abs(got[d] - want[d]) > 1e-6 for d in want) <= 2


def test_steps_of_the_similarity_join_go_before_texts_are_joined(spark, tmp_path, monkeypatch):
    from streamquarry.llm import jaccard_join

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(workspace, "shared_dir", lambda _: str(tmp_path))
    found = jaccard_join.similar_documents(docs)
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not left & {"shingles", "classes", "shared", "sets", "pairs", "large"} and "labelled" in left
    assert found.count() == docs.count()


def test_similarity_join_deals_prefixes_out_once_and_drops_used_steps(spark, tmp_path, monkeypatch):
    from streamquarry.llm import jaccard_join

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(workspace, "shared_dir", lambda _: str(tmp_path))
    there, plans, inner = {}, [], jaccard_join.write_step

    def watched(df, label):
        there.setdefault(label, {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()})
        plans.append(plan_of(df))
        return inner(df, label)

    monkeypatch.setattr(jaccard_join, "write_step", watched)
    jaccard_join.similar_documents(docs)
    assert sum("partial_first(prefix" in p for p in plans) == 1
    assert not there["shared"] & {"sets", "wanted"}
    assert not there["pairs"] & {"shingles", "sets"}


def test_tables_of_places_take_one_job(spark):
    import numpy as np

    from streamquarry.llm.places import table_of_places

    rows = spark.range(0, 4000, 1, 4).selectExpr("id * 16 AS place")
    to_places = lambda column: [column.to_numpy(zero_copy_only=False)]
    tracker = spark.sparkContext.statusTracker()
    for flags in (False, True):
        spark.sparkContext.setJobGroup(f"places-{flags}", "a table of 16 blocks, a partition each")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        try:
            table = table_of_places(rows, "place", to_places, 20, flags)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        table = np.unpackbits(table) if flags else table
        assert np.array_equal(np.flatnonzero(table), np.arange(0, 64000, 16))
        # the shuffle and the fetch; an iterator ran one more for each of the 40 partitions
        assert len(tracker.getJobIdsForGroup(f"places-{flags}")) <= 2


def test_states_of_components_take_no_job_of_their_own(spark, monkeypatch):
    from streamquarry.llm import components as module

    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 6)], "a long, b long")
    edges, state = module._summed(links.filter("a <> b").selectExpr("b AS u", "a AS v"))
    assert state["n"] == 3 == edges.count()
    assert state["sum"] == sum(edges.selectExpr("xxhash64(u, v) AS h").toPandas().h.astype(object))
    assert {r.node: r.label for r in module.components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert module.components(links.filter("a = b")).count() == 0


def test_steps_of_components_are_written_by_few_tasks(spark, monkeypatch):
    from streamquarry.llm import components as module

    links = spark.range(3000).selectExpr("id AS a", "id - id % 3 AS b")
    files, inner = {}, module.stored

    def watched(df, label):
        written = inner(df, label)
        files.setdefault(label, []).append(len(written.inputFiles()))
        return written

    monkeypatch.setattr(module, "stored", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r.node: r.label for r in module.components(links).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i - i % 3 for i in range(3000)}
    assert max(files["stars"] + files["edges"][1:]) <= module.TASKS


def test_levels_of_places_are_those_of_the_whole_formula(spark, monkeypatch):
    import numpy as np

    from streamquarry.llm import jaccard_join

    counts = np.random.default_rng(1).geometric(0.02, 1 << 12).astype(np.uint32)
    counts[:5] = [0, 1, 10**5, 10**6, 2**31]
    monkeypatch.setattr(jaccard_join, "table_of_places", lambda *_: counts)
    usual = counts.mean() + 6 * counts.mean() ** 0.5 + 8
    want = np.where(counts < usual, 0, np.floor(2 * np.log2(np.maximum(counts, 1) / usual)) + 1).astype(np.uint8)
    assert np.array_equal(jaccard_join.shingle_levels(None, "text", 5), want) and want.max() > 20


def test_links_found_in_a_task_are_not_checked_again(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from streamquarry.llm import jaccard_join
    from streamquarry.llm.signature_tree import signature

    rng = np.random.default_rng(2)
    bases = [np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(2)]
    sets = [np.sort(np.delete(bases[k % 2], k)) for k in range(20)]
    names = ["token", "i", "j", "side", "class", "label", "n", "bits", "set"]
    batches = [pa.RecordBatch.from_arrays(
        [pa.array(x) for x in ([t] * 20, [0] * 20, [0] * 20, [0] * 20, [*range(20)], [*range(20)], [len(s) for s in sets],
                               [signature(s) for s in sets], [s.tobytes() for s in sets])], names) for t in range(30)]
    asked, similar = [], jaccard_join._similar
    monkeypatch.setattr(jaccard_join, "_similar", lambda *a: asked.append(similar(*a)) or asked[-1])
    found = [p for b in jaccard_join._block_links(75, 100)(batches) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    # the two components, each link once for all groups of the task: 18 of them, not 540
    assert len(found) == 18 and sum(asked) == 18 and all(a % 2 == b % 2 for a, b in found)
