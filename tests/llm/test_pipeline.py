from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from llm import plain
from llm.conftest import ODD_ROWS
from llm.test_dedup_sharding import normal
from llm.test_pairs_packing import check_packing
from llm.test_quality import plain_fit
from pyspark.sql import functions as F

from streamquarry.llm import mixing, quality_rules
from streamquarry.llm.rows import stored


def plain_mix(docs, labels):
    """The rows a mix keeps: rates by projected gradients in numpy, on the posteriors of the stage."""
    model, known = mixing.learned(docs, labels)
    hashed = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)
    rows = mixing.with_domains(docs, model, docs.columns).withColumn("chance", hashed).collect()
    if not rows:
        return []
    p, tokens = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows]), np.array([r.n_tokens for r in rows], float)
    share, present = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS]) @ known, p.T @ tokens

    def descent(wanted):
        rate, gaps = np.ones(len(rows)), []
        while True:
            over = p.T @ (rate * tokens) - wanted
            gaps.append(np.abs(over).sum() / wanted.sum())
            if gaps[-1] <= 1e-4:
                return rate if rate.max() <= mixing.MOST_RATE else None
            if len(gaps) > mixing.PATIENCE and min(gaps[-mixing.PATIENCE :]) > 0.9 * min(gaps[: -mixing.PATIENCE]):
                return None
            rate = np.maximum(0, rate - p @ (np.linalg.pinv((p * (tokens * (rate > 0))[:, None]).T @ p, rcond=1e-10) @ over))

    rate, now = None, present / present.sum()
    for halving in range(mixing.HALVINGS + 1):
        aim = now + (share - now) / 2**halving
        rate = descent(aim * present[share.argmax()] / aim[share.argmax()])
        if rate is not None:
            break
    rate = np.ones(len(rows)) if rate is None else rate
    return [r.row for r, x in zip(rows, rate, strict=True) if np.floor(x + r.chance) > 0]


def follow(spark, docs, sf):
    """Each stage against a plain version of it on what the stage before kept."""
    columns = docs.columns
    text = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf), name)
        after = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert not text(after) - text(before)
        if name == "quality_rules":
            votes = quality_rules.with_votes(spark.createDataFrame(before, docs.schema), "text", ["doc_id", "text"]).collect()
            p = plain_fit(Counter(tuple(r[v] for v in quality_rules.VOTES) for r in votes if not r.base_failed))
            want = Counter(
                (r.row.doc_id, r.row.text) for r in votes
                if not r.base_failed and p(tuple(r[v] for v in quality_rules.VOTES)) >= 0.5)
            assert text(after) == want
            assert all(plain.measures(r.text)[0] >= 20 for r in after)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
                if normal(r.text) not in best or key < best[normal(r.text)][0]:
                    best[normal(r.text)] = key, r
            assert text(after) == text(r for _, r in best.values())
        elif name == "ngram_jaccard_join":
            sets, root = plain.similar([r.text for r in before])
            groups = {}
            for r, x, k in zip(before, sets, root, strict=True):
                groups.setdefault(k if x else ("alone", r.doc_id, id(r)), []).append(r)
            least = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in least)
        elif name == "mixing":
            table = spark.createDataFrame(before, docs.schema)
            assert text(after) == text(plain_mix(table, spark.read.parquet(f"{sf}/labels.parquet")))
            assert len(after) >= 0.5 * len(before)
        else:
            used, bound = check_packing([(r.doc_id, r.text) for r in before], after, 2048)
            assert used <= bound + 1
    return after


def test_generated_documents(spark, sf):
    rows = follow(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == len(rows)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_clean_documents_stay_in_the_mix(spark, size):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in mixing.stage(spark, docs, f"/root/testdata/{size}").collect()}
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).collect()
    clean = [r.doc_id for r in marks if r.good and not r.toxic]
    toxic = [r.doc_id for r in marks if r.toxic]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i in toxic) <= 0.6 * len(toxic)


def test_odd_rows(spark, odd_docs, sf):
    assert {r.doc_id for r in follow(spark, odd_docs, sf)} <= {r[0] for r in ODD_ROWS}


def test_empty_table(spark, no_docs, sf):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
    assert docs.count() == 0
