from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from streamquarry.llm import de_bruijn
from streamquarry.llm.rows import FILE, ROW
from tests.llm.plain import words
from tests.llm.test_rewriting import digest


def plain_repeats(rows, n=13):
    """``(doc_id, n_words, n_removed, kept_sha256)`` by definition; a null id is larger than all others."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    texts = [(doc_id, words(text)) for doc_id, text in rows]
    for doc_id, w in texts:
        for i in range(len(w) - n + 1):
            gram = tuple(w[i : i + n])
            first[gram] = min(first.get(gram, rank(doc_id)), rank(doc_id))
    out = []
    for doc_id, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < rank(doc_id):
                gone[i : i + n] = [True] * n
        out.append((doc_id, len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def check(docs, n=13):
    got = [(r.id, r.n_words, r.n_removed, r.kept_sha256) for r in de_bruijn.repeats(docs, n=n).collect()]
    want = plain_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    return want


def test_odd_rows(odd_docs):
    assert any(r[2] for r in check(odd_docs))


def test_nothing(no_docs):
    assert de_bruijn.repeats(no_docs).count() == 0
    assert de_bruijn.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("seed", "n", "letters"), [(1, 13, 40), (2, 13, 2), (3, 5, 3), (4, 8, 4), (5, 9, 3)])
def test_random_texts(spark, seed, n, letters):
    """Few words, so that paths branch, loop and overlap; passages, copies, repeated ids and rows."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(letters)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(n, 4 * n))] for _ in range(6)]
    rows = []
    for i in range(90):
        w = []
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randrange(2 * n))]
        rows.append((rng.choice([i, i // 2, None if rng.random() < 0.1 else i]), rng.choice([" ", "\n", " \t"]).join(w)))
    rows += rng.sample(rows, 15) + [(200 + i, t) for i, (_, t) in enumerate(rng.sample(rows, 15))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n)


def test_long_texts_are_many_groups(spark, monkeypatch):
    monkeypatch.setattr(de_bruijn, "BLOCK", 16)
    rng = random.Random(9)
    text = " ".join(f"x{rng.randrange(5000)}" for _ in range(3000))
    rows = [(1, text), (2, "first " + text), (3, text + " last"), (4, text[len(text) // 2 :])]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_compaction(spark):
    """Only neighbours that are plain on both sides share a path."""
    edges = spark.createDataFrame(
        [(10 + p, 1, 1, p, p != 3) for p in range(6)] + [(30, 1, 2, 5, True), (31, 1, 2, 7, True)],
        f"gram long, {FILE} long, {ROW} long, pos int, plain boolean")
    paths = {(r.gram, r.pos, r.length) for r in de_bruijn.compact(edges).collect()}
    assert paths == {(10, 0, 3), (13, 3, 1), (14, 4, 2), (30, 5, 1), (31, 7, 1)}


def test_clean_texts_keep_their_columns(spark, odd_docs):
    clash = odd_docs.withColumns({FILE: F.lit("f"), "removed": F.lit("r"), "_metadata": F.lit("m")})
    rows = de_bruijn.without_repeats(clash).collect()
    want = {}
    for doc_id, _, _, kept in plain_repeats([(r.doc_id, r.text) for r in odd_docs.collect()]):
        want.setdefault(doc_id, []).append(kept)
    assert len(rows) == odd_docs.count() and set(rows[0].row.__fields__) == set(clash.columns)
    for r in rows:
        assert digest(r.clean_text) in want[r.row.doc_id]
        assert sum(s.words for s in r.removed) == len(words(r.row.text)) - len(words(r.clean_text))
