from __future__ import annotations

from collections import Counter

import pytest
from llm import plain
from llm.conftest import ODD_ROWS
from pyspark.sql import functions as F

from streamquarry.llm import byte_cnn, quality_rules

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain_fit(patterns, iterations=40, tolerance=1e-7):
    """The same estimation over a dict from votes to counts."""
    k = len(quality_rules.RULES)
    prior, good, bad = 0.7, [{1: 0.78, 0: 0.2, -1: 0.02}] * k, [{1: 0.3, 0: 0.3, -1: 0.4}] * k

    def p_good(votes):
        a, b = prior, 1 - prior
        for v, g, h in zip(votes, good, bad, strict=True):
            a, b = a * g[v], b * h[v]
        return a / (a + b)

    for _ in range(iterations):
        p = {votes: p_good(votes) for votes in patterns}
        g, b = sum(n * p[v] for v, n in patterns.items()), sum(n * (1 - p[v]) for v, n in patterns.items())
        last, prior = prior, min(max((g + 1) / (g + b + 2), 1e-6), 1 - 1e-6)
        good = [{x: (sum(n * p[v] for v, n in patterns.items() if v[i] == x) + 1) / (g + 3) for x in (1, 0, -1)} for i in range(k)]
        bad = [{x: (sum(n * (1 - p[v]) for v, n in patterns.items() if v[i] == x) + 1) / (b + 3) for x in (1, 0, -1)} for i in range(k)]
        if abs(prior - last) < tolerance:
            break
    return p_good


def check(rows, texts):
    patterns = Counter(tuple(r[v] for v in quality_rules.VOTES) for r in rows if not r.base_failed)
    p_good = plain_fit(patterns)
    for r in rows:
        n, _, _, _, repeated = tuple(r[x] for x in NAMES)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        p = p_good(tuple(r[v] for v in quality_rules.VOTES))
        assert abs(p - r.p_good) < 1e-6
        assert r.kept == (not r.base_failed and p >= 0.5)
    assert Counter((r.id, *(r[x] for x in NAMES)) for r in rows) == Counter((i, *plain.measures(t)) for i, t in texts)


def test_measures_and_verdict(odd_docs):
    rows = quality_rules.score_quality(odd_docs, carry=["doc_id"]).withColumn("id", F.col("row.doc_id")).collect()
    check(rows, [(r[0], r[1]) for r in ODD_ROWS])


def test_repeated_windows(spark):
    a = " ".join("abcdefgh")
    texts = [f"{a} {a}", f"{a} x {a} y", " ".join("z" * 11), " ".join("ab" * 9), a, f"{a} i {a} i q {a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.score_quality(docs, carry=["doc_id"]).withColumn("id", F.col("row.doc_id")).collect()
    check(rows, list(enumerate(texts)))


def test_generated_documents_against_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality_rules.score_quality(docs, carry=["doc_id"]).withColumn("id", F.col("row.doc_id")).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    quality = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    rated = [(quality[r.id], r.kept) for r in rows if r.id in quality and not r.base_failed]
    assert all(kept for q, kept in rated if q == 1)
    assert sum(kept for q, kept in rated if q == 0) <= 0.2 * sum(q == 0 for q, _ in rated)


def test_empty_table(spark, no_docs):
    assert quality_rules.score_quality(no_docs).count() == 0
    assert quality_rules.stage(spark, no_docs, "").columns == no_docs.columns


def test_no_python_in_the_plan(odd_docs):
    plan = quality_rules.score_quality(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_network_scores_whole_texts(spark, sf, odd_docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = dict(labels.select("doc_id", "quality").collect())
    got = {r.doc_id: r.score for r in byte_cnn.score_quality(docs, labels, steps=250).collect()}
    held = [i for i in quality if plain.crc(i) % 5 == 0]
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == docs.count()
    right = sum((got[i] >= 0.3) == (quality[i] == 1) for i in held)
    assert right >= 0.8 * len(held)


def test_network_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(1, 16)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = byte_cnn.score_quality(odd_docs, labels, steps=3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD_ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    assert byte_cnn.score_quality(no_docs, labels.limit(0)).count() == 0
    assert {r.score for r in byte_cnn.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_chunks_cover_the_text(n):
    starts = byte_cnn.chunk_starts(n)
    covered = {i for s in starts.tolist() for i in range(s, s + byte_cnn.CHUNK)}
    assert covered >= set(range(n))


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in byte_cnn.new_network(1).items()}
    chunks, label, weight = rng.integers(0, 257, (6, byte_cnn.CHUNK)), np.array([0, 1, 1]), np.array([2.0, 1, 1])
    grads, _ = byte_cnn._gradients(net, chunks, 3, label, weight)
    for name in net:
        at = np.unravel_index(np.abs(grads[name]).argmax(), net[name].shape)
        loss = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in net.items()}
            moved[name][at] += step
            loss.append(byte_cnn._gradients(moved, chunks, 3, label, weight)[1])
        assert abs((loss[0] - loss[1]) / 2e-5 - grads[name][at]) < 1e-3
