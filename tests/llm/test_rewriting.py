from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamquarry.llm import fill_middle, importance_resampling
from tests.llm.plain import LOWER

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_rewrite(doc_id, text, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexes = digest(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def more_texts():
    rng = random.Random(3)
    pool = ["a", "Grüße", "\n", "\r", "<", "<P", ">", "中", "\x85", " ", " ", "🙂"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(150)]
    return [*texts, "<P>", "x<S>y", "<M>\n", "\n", "\n\n", "a\n", "\na", "<\n<S", "a" * 300_000 + "\n" * 200_000]


def test_fill_in_middle(spark, odd_docs):
    docs = odd_docs.unionByName(spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(more_texts())], "doc_id long, text string"), allowMissingColumns=True)
    rows = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_rewrite(r.row.doc_id, r.row.text)
        assert r.back == (r.row.text or "")
    assert set(rows[0].row.__fields__) == set(docs.columns)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_fill_in_middle_rates_and_small_slices(spark, odd_docs, monkeypatch):
    stay = fill_middle.fill_in_middle(odd_docs, ["doc_id"], rewritten=0)
    assert {r.form for r in stay.collect()} == {"plain"}
    assert {r.form for r in fill_middle.fill_in_middle(odd_docs, ["doc_id"], spm=100).collect()} == {"plain", "spm"}
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "BYTES", 5)
    texts = pa.array(["ab", "", "abcdefghij", "c", "", "de"])
    assert [x for s, n in fill_middle._slices(texts) for x in texts.slice(s, n).to_pylist()] == texts.to_pylist()


def test_fill_in_middle_of_nothing(no_docs):
    assert fill_middle.fill_in_middle(no_docs).count() == 0


def plain_features(text, n_max):
    words = FEATURE.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=10, min_words=20, n_max=1, buckets=10_000, seed="2024"):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t, n_max)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, features = plain_features(text, n_max)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features)
        h = int(digest(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(words), len(features), weight, score))
    eligible = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = eligible[: math.floor(percent * len(eligible) / 100)]
    rank = {}
    for i, r in enumerate(drawn):
        rank.setdefault(r, []).append(i + 1)
    out = []
    for r in rows:
        left = rank.get(r)
        out.append((r[0], *r[2:], left.pop(0) if left else None))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize(("percent", "n_max"), [(10, 1), (50, 3), (100, 2)])
def test_importance_resampling(spark, odd_docs, percent, n_max):
    rng = random.Random(5)
    pool = ["alpha", "Beta", "x1", "ÄÖ", "z" * 70, "q" * 64, "w" * 65, "\x7f", "-", "中文", "10", "ß"]
    texts = [rng.choice([" ", "\n", "--"]).join(rng.choices(pool, k=rng.randrange(60))) for _ in range(120)]
    more = spark.createDataFrame([(100 + i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([("alpha beta 10",), (None,), ("x1 ÄÖ x1",)], "text string")
    got = importance_resampling.resampled(docs, target, percent=percent, n_max=n_max, buckets=500).select(
        "kept.doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain_resample(
        [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, n_max=n_max, buckets=500)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_importance_resampling_of_whole_tables(spark, sf):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = importance_resampling.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_importance_resampling_of_nothing(spark, no_docs, odd_docs):
    assert importance_resampling.resampled(no_docs, odd_docs).count() == 0
    assert importance_resampling.resampled(odd_docs, no_docs).count() == odd_docs.count()


def test_composed_checksums():
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    crc = lambda x: np.array([zlib.crc32(b) for b in x], np.uint32)
    got = importance_resampling.appended(crc(a for a, _ in pairs), crc(b for _, b in pairs), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
