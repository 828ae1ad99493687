from __future__ import annotations

import hashlib
import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from llm import plain
from llm.conftest import ODD_ROWS, table
from pyspark.sql import functions as F

from streamquarry.llm import language_id, line_chunks, mixing, ngram_filter, textarrays


def test_word_hashes_of_texts():
    import pyarrow as pa

    texts = ["", "One  two\tONE", None, "two", " é ÉÉ\n", "x" * 5000, "one"]
    parts = list(textarrays.pieces(pa.array(texts), size=10))
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == len(texts)
    seen = {}
    for start, end, data, offsets in parts:
        w = textarrays.word_hashes(data, offsets)
        for i in range(end - start):
            own = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist()
            words = plain.lower_words(texts[start + i])
            assert len(own) == len(words)
            for a, b in zip(words, own, strict=True):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def check_base(rows, got):
    tokens = [(plain.crc(r[0]) % 7 == 2, [*plain.lower_words(r[1]), "\0end"]) for r in rows]
    counts = Counter(t for held, ts in tokens if not held for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = Counter(
        (r[0], held, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 4))
        for r, (held, ts) in zip(rows, tokens, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


@pytest.mark.parametrize("frequent", [1 << 18, 3, 0])
def test_base_score(monkeypatch, odd_docs, frequent):
    monkeypatch.setattr(ngram_filter, "FREQUENT", frequent)
    got = ngram_filter.score_texts(odd_docs, ~ngram_filter.held_out("doc_id", 2, 7)).collect()
    check_base(ODD_ROWS, got)
    assert all(r.score < 0 for r in got)


def test_model_beats_base_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ngram_filter.score_texts(docs, ~ngram_filter.held_out("doc_id", 2, 7)).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_never_reads_too_low(spark):
    rng = np.random.default_rng(0)
    grams = rng.integers(-(1 << 63), (1 << 63) - 1, 4000)
    n = np.maximum(1, rng.pareto(0.6, 4000).astype(np.int64))
    counts = spark.createDataFrame([(int(a), int(b)) for a, b in zip(grams, n, strict=True)], "gram long, n long")
    held, bits, least = ngram_filter.build_filter(counts, 1 << 24)
    assert least == 1
    level = ngram_filter.read_levels(held, bits, grams.view(np.uint64))
    true = np.searchsorted(ngram_filter.LEVELS, n, "right")
    assert (level >= true).all() and (level == true).mean() > 0.9
    other = rng.integers(0, (1 << 63) - 1, 4000).view(np.uint64)
    assert (ngram_filter.read_levels(held, bits, other) > 0).mean() < 0.1
    small, bits, least = ngram_filter.build_filter(counts, 1 << 13)
    assert least > 1 and bits <= 16


def test_pairs_counted_once_are_held(spark, odd_docs):
    counted = Counter()
    for r in ODD_ROWS:
        tokens = [*plain.lower_words(r[1]), "\0end"]
        counted.update(zip(["\0start", *tokens], tokens))
    counts = ngram_filter.count_grams(odd_docs, "text")
    pairs = counts.filter(F.col("gram").bitwiseAND(1) == 1).toArrow()
    assert Counter(pairs["n"].to_pylist()) == Counter(counted.values()) and 1 in counted.values()
    held, bits, least = ngram_filter.build_filter(counts, 1 << 30)
    level = ngram_filter.read_levels(held, bits, pairs["gram"].to_numpy().view(np.uint64))
    assert least == 1 and (level >= np.searchsorted(ngram_filter.LEVELS, pairs["n"].to_numpy(), "right")).all()


def test_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_filter.score_texts(no_docs, F.lit(True)).count() == 0
    assert mixing.mixed(no_docs, none, ["doc_id"]).count() == 0
    assert line_chunks.drop_repeated_chunks(no_docs).count() == 0
    assert language_id.fit_trigrams(no_docs)[0] == []


def test_rates_reach_the_targets(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    members = mixing.stored(mixing.with_domains(docs, mixing.learned(docs, labels)[0], ["doc_id"]), "m")
    for weights in ({"clean": 0.9, "junk": 0.05, "toxic": 0.05}, {"clean": 0.5, "junk": 0.4, "toxic": 0.1}):
        path, wanted, expected = mixing.fit_rates(members, weights)
        assert np.abs(expected - wanted).sum() < 1e-4 * wanted.sum()
        rows = members.withColumn("rate", mixing.rate_of(path)).collect()
        assert all(r.rate >= 0 for r in rows)
        for k, d in enumerate(mixing.DOMAINS):
            assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) - wanted[k]) < 1e-3 * wanted.sum()


def test_rates_equal_plain_projected_gradients(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3] * 3, 200)
    tokens = rng.integers(1, 500, 200)
    members = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p, strict=True)], "n_tokens long, p_clean double, p_junk double, p_toxic double")
    path, wanted, _ = mixing.fit_rates(members, {"clean": 0.9, "junk": 0.08, "toxic": 0.02})
    rate = np.ones(200)
    for _ in path:
        metric = np.linalg.pinv((p * (tokens * (rate > 0))[:, None]).T @ p, rcond=1e-10)
        rate = np.maximum(0, rate - p @ (metric @ (p.T @ (rate * tokens) - wanted)))
    got = [r.rate for r in members.select(mixing.rate_of(path).alias("rate")).collect()]
    assert np.allclose(sorted(got), sorted(rate), atol=1e-6)


def test_plan_of_a_step_does_not_repeat_the_steps_before(spark, monkeypatch):
    """The driver plans a step for each vector; its plan holds the vectors once, not once per sum."""
    plans, totals = [], mixing._totals

    def seen(members, *more):
        plans.append(members.agg(*more)._jdf.queryExecution().optimizedPlan().toString())
        return totals(members, *more)

    monkeypatch.setattr(mixing, "_totals", seen)
    members = spark.createDataFrame([(10, 0.6, 0.3, 0.1)] * 20, "n_tokens long, p_clean double, p_junk double, p_toxic double")
    with pytest.warns(UserWarning, match="no rates meet"):
        mixing.fit_rates(members, mixing.WEIGHTS)
    steps = [p for p in plans if "aggregate(" in p]
    assert len(steps) > mixing.PATIENCE and {p.count("aggregate(") for p in steps} == {1}


def test_soft_posteriors_are_measured_against_their_confusion(spark):
    """Of documents that are all clean, by a classifier that is never sure, all stay."""
    rng = np.random.default_rng(3)
    soft = np.array([[0.9, 0.06, 0.04], [0.3, 0.6, 0.1], [0.4, 0.1, 0.5]])
    kinds = rng.choice(3, 600, p=[0.9, 0.06, 0.04])
    p = np.clip(soft[kinds] + rng.normal(0, 0.03, (600, 3)), 0.001, None)
    p /= p.sum(axis=1, keepdims=True)
    members = mixing.stored(spark.createDataFrame(
        [(100, *map(float, x), int(k)) for x, k in zip(p, kinds, strict=True)],
        "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS) + ", kind int"), "soft")
    known = np.stack([p[kinds == k].mean(axis=0) for k in range(3)])
    path, wanted, reached = mixing.fit_rates(members, mixing.WEIGHTS, known)
    assert np.abs(wanted - reached).sum() <= 1e-4 * wanted.sum()
    rates = [r.rate for r in members.filter("kind = 0").select(mixing.rate_of(path).alias("rate")).collect()]
    assert np.minimum(rates, 1).mean() > 0.97
    rows = members.select("kind", mixing.rate_of(path).alias("rate")).collect()
    tokens = np.bincount([r.kind for r in rows], [r.rate for r in rows])
    assert np.allclose(tokens / tokens.sum(), [0.96, 0.02, 0.02], atol=0.02)


def test_targets_out_of_reach_are_told(spark):
    members = spark.createDataFrame([(10, 0.6, 0.3, 0.1)] * 20, "n_tokens long, p_clean double, p_junk double, p_toxic double")
    with pytest.warns(UserWarning, match="no rates meet"):
        path, wanted, reached = mixing.fit_rates(members, mixing.WEIGHTS)
    assert path == [] and np.allclose(reached, [120, 60, 20])


def test_classifier_on_held_out(spark, sf, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: "toxic" if r.toxic else "clean" if r.quality else "junk" for r in labels.collect()}
    rows = mixing.with_domains(docs, mixing.learned(docs, labels)[0], ["doc_id"]).collect()
    held = [(truth[r.row.doc_id], max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"])) for r in rows if r.row.doc_id in truth and plain.crc(r.row.doc_id) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)
    out = mixing.mixed(odd_docs, labels, odd_docs.columns)
    assert Counter(r.row.doc_id for r in out.collect()) == Counter(r[0] for r in ODD_ROWS)


def test_repeated_chunks_go_once(spark):
    rng = np.random.default_rng(1)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10_000, 6))
    shared = [line() for _ in range(30)]
    rows = [(i, "\n".join([line() for _ in range(int(rng.integers(0, 6)))] + shared + [line()]), None, None, None) for i in range(20)]
    out = {r.row.doc_id: r for r in line_chunks.drop_repeated_chunks(table(spark, rows), ["doc_id", "text"]).collect()}
    assert out[0].clean_text == out[0].row.text and out[0].n_removed == 0
    for i in range(1, 20):
        kept = out[i].clean_text.split("\n")
        assert sum(x in set(shared) for x in kept) <= 10  # the chunks that hold the passage's ends may stay
        assert [x for x in rows[i][1].split("\n") if x not in set(shared)] == [x for x in kept if x not in set(shared)]
        assert out[i].n_removed > 0 and out[i].n_lines_kept == len(kept)


@pytest.mark.parametrize("n_lines", [1, 3])
def test_passages_of_long_lines_go_between_any_neighbours(spark, n_lines):
    rng = np.random.default_rng(2)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1_000_000, n))
    passage = [line(60) for _ in range(n_lines)]
    rows = []
    for i in range(40):
        before, after = ([line(6) for _ in range(int(rng.integers(1, 6)))] for _ in range(2))
        rows.append((i, "\n".join([*before, *passage, *after]), None, None, None))
    out = {r.row.doc_id: r for r in line_chunks.drop_repeated_chunks(table(spark, rows), ["doc_id", "text"]).collect()}
    assert out[0].clean_text == rows[0][1] and out[0].n_removed == 0
    for i in range(1, 40):
        assert out[i].clean_text.split("\n") == [x for x in rows[i][1].split("\n") if x not in passage]
        assert out[i].n_removed == n_lines


def test_chunks_hold_two_worded_lines_or_a_long_one():
    rng = np.random.default_rng(3)
    lines = [" ".join(["w" + str(rng.integers(1 << 40))] * int(n)) for n in rng.choice([0, 1, 6, line_chunks.LONG - 1, line_chunks.LONG], 2000)]
    text = "\n".join(lines).encode()
    begin, stop, tail, _, _, counted, n_lines = line_chunks.chunks_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert begin[0] == 0 and stop[-1] == len(text) and (begin[1:] == stop[:-1]).all() and n_lines == [2000]
    own = [[len(x.split()) for x in text[s:e].decode().split("\n")] for s, e in zip(begin, tail, strict=True)]
    is_long = [max(x) >= line_chunks.LONG for x in own]
    assert all(len(x) == 1 for x, alone in zip(own, is_long, strict=True) if alone)
    # before a long line and at the end of the text fewer may be left over
    assert all(sum(n > 0 for n in own[i]) >= 2 for i in range(len(own) - 1) if not is_long[i] and not is_long[i + 1])
    assert [c >= 2 for c in counted] == [alone or sum(n > 0 for n in x) >= 2 for x, alone in zip(own, is_long, strict=True)]


def plain_chunks(rows):
    """Chunks by bytes over all rows; which of them stay."""
    seen, out = set(), Counter()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        data = np.frombuffer((rows[i][1] or "").encode(), np.uint8)
        begin, stop, tail, _, _, lines, _ = line_chunks.chunks_of(data, np.array([0, len(data)]))
        kept, gone, last_gone = b"", 0, False
        for s, e, t, n in zip(begin, stop, tail, lines, strict=True):
            content = data[s:t].tobytes()
            last_gone = n >= 2 and content in seen
            if n >= 2:
                seen.add(content)
            gone += last_gone
            kept += b"" if last_gone else data[s:e].tobytes()
        out[rows[i][0], gone, hashlib.sha256(kept.removesuffix(b"\n") if last_gone else kept).hexdigest()] += 1
    return out


def test_chunks_equal_plain(spark, odd_docs, sf):
    got = line_chunks.drop_repeated_chunks(odd_docs, ["doc_id"]).collect()
    assert Counter((r.row.doc_id, r.n_removed, hashlib.sha256(r.clean_text.encode()).hexdigest()) for r in got) == plain_chunks(ODD_ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = line_chunks.drop_repeated_chunks(docs, ["doc_id"]).collect()
    want = plain_chunks([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.row.doc_id, r.n_removed, hashlib.sha256(r.clean_text.encode()).hexdigest()) for r in got) == want


def test_colliding_chunk_keys_are_compared_by_bytes(spark, monkeypatch):
    rows = [(i, f"first {i}\nsecond {i}", None, None, None) for i in range(6)] + [(9, "first 3\nsecond 3", None, None, None)]
    real = line_chunks.chunks_of

    def same_keys(data, offsets):
        out = list(real(data, offsets))
        out[4] = np.zeros_like(out[4])
        return tuple(out)

    monkeypatch.setattr(line_chunks, "chunks_of", same_keys)
    got = {r.row.doc_id: r.n_removed for r in line_chunks.drop_repeated_chunks(table(spark, rows), ["doc_id"]).collect()}
    assert got == dict.fromkeys(range(6), 0) | {9: 0}


def test_languages_of_documents_and_pages(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    model = language_id.fit_trigrams(docs)
    true = dict(docs.select("doc_id", "lang").collect())
    rows = language_id.identify(language_id.document_evidence(docs, model).withColumn("row", F.col("id")).drop("id"), model[0]).collect()
    held = [r for r in rows if plain.crc(r.row) % 5 == 0]
    assert sum(true[r.row] == r.language for r in held) >= 0.95 * len(held) and len(rows) == docs.count()
    got = language_id.query(spark, sf).collect()
    assert sorted(r.page_id for r in got if r.page_id is not None) == sorted(r.page_id for r in pages.select("page_id").collect())
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows)


def test_evidence_of_odd_pages(spark, sf):
    model = language_id.fit_trigrams(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = spark.createDataFrame([
        (1, "https://a.example.com/de/1", "<html lang='de'></html>"), (2, None, None), (None, "nonsense", ""),
        (3, "https://a.example.com/de/2", "<html><script>the the the</script></html>"), (3, "http://x.org", "<p>The that is of and with</p>"),
    ], "page_id long, url string, html string")
    evidence = language_id.page_evidence(pages, model).withColumn("row", F.col("id")).drop("id")
    rows = language_id.identify(evidence, model[0]).collect()
    assert len(rows) == 5 and all(r.language in model[0] for r in rows)
    assert {r.hint for r in rows} == {"de", None, "org"} and {r.declared for r in rows} == {"de", None}


def test_empty_texts_get_the_language_of_their_host(spark):
    words = {"de": "der hund und die katze sind nicht auf dem dach", "en": "the dog and the cat are not on the roof"}
    rows = [(i, f"{words['de']} {i}", "de", "s1", 1) for i in range(60)]
    rows += [(100 + i, f"{words['en']} {i}", "en", "s2", 1) for i in range(200)]
    rows += [(900, "", None, "s1", 0), (901, None, None, "s1", 0), (902, "", None, "s2", 0), (903, "", None, None, 0), (904, "", None, "s3", 0)]
    docs = table(spark, rows)
    model = language_id.fit_trigrams(docs)
    evidence = language_id.document_evidence(docs, model).withColumn("row", F.col("id")).drop("id")
    got = language_id.identify(evidence, model[0]).collect()
    assert Counter(r.row for r in got) == Counter(r[0] for r in rows)
    found = {r.row: (r.language, r.host) for r in got}
    assert found[900] == ("de", "s1") and found[901] == ("de", "s1") and found[902] == ("en", "s2")
    assert found[903] == ("en", None) and found[904] == ("en", "s3")  # no host, or one of which nothing is known
    pages = spark.createDataFrame(
        [(i, "http://intern/x", f"<p>{words['de']} {i}</p>") for i in range(60)] + [(100 + i, "http://a.org/x", f"<p>{words['en']} {i}</p>") for i in range(200)]
        + [(900, "http://intern/y", "")], "page_id long, url string, html string")
    evidence = language_id.page_evidence(pages, model).withColumn("row", F.col("id")).drop("id")
    assert [r.language for r in language_id.identify(evidence, model[0]).collect() if r.row == 900] == ["de"]


def test_visible_text():
    assert language_id.visible_text("<nav>no</nav><!-- <p>no --><P>a &amp; b</P><script>no</script >").split() == ["a", "&", "b"]


def test_visible_text_equals_lazy_patterns_and_is_linear():
    hidden = re.compile(r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>")
    parts = ["<nav>", "</nav >", "<NAV a", "</Nav>", "<!--", "-->", "<script>", "</script>", "<style", "</style\n>",
             "<", ">", "<b>", "word ", "&amp;", "<navy>", "</nav"]
    rng = random.Random(8)
    for _ in range(5000):
        page = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        want = html.unescape(re.sub(r"(?s)<[^>]*>", " ", hidden.sub(" ", page)))
        assert language_id.visible_text(page) == want, page
    start = time.process_time()
    for piece in ("<nav>", "<", "<!--", "</nav", "<nav>-->", "<script></style>", "<b"):
        language_id.visible_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 15
