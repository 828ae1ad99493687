from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm import plain
from llm.conftest import ODD_ROWS, table

from streamquarry.llm import bin_completion, jaccard_join, packing
from streamquarry.llm.components import components
from streamquarry.llm.signature_tree import candidate_pairs, signature


def expected(rows):
    sets, root = plain.similar([r[1] for r in rows])
    least = {}
    for r, x, k in zip(rows, sets, root, strict=True):
        if x and r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], len(x), least.get(k) if x else r[0]) for r, x, k in zip(rows, sets, root, strict=True))


def found(docs, **options):
    return jaccard_join.similar_documents(docs, **options).collect()


def test_odd_rows(odd_docs):
    got = found(odd_docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(ODD_ROWS)
    _, root = plain.similar([r[1] for r in ODD_ROWS])
    without = sum(not plain.words(r[1]) for r in ODD_ROWS)
    assert sum(r.stays for r in got) == without + len({k for r, k in zip(ODD_ROWS, root, strict=True) if plain.words(r[1])})


def near_copies(seed, n_bases=4, copies=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(n_bases):
        base = rng.choices(vocabulary, k=rng.randint(8, 150))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own) + (f"\n{passage}" if rng.random() < 0.4 else "")
            rows.append((len(rows), text, None, None, None))
    return rows


@pytest.mark.parametrize(("large", "block"), [(64, 4096), (4, 7)])
def test_groups_of_near_copies_and_a_shared_passage(spark, monkeypatch, large, block):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(large)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found(table(spark, rows))) == expected(rows)


def test_generated_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found(docs)) == expected(rows)


def test_empty_table(spark, no_docs):
    assert found(no_docs) == []
    assert packing.pack(no_docs).count() == 0


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    for trial in range(40):
        bases = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(2, 90)):
            base = bases[rng.integers(4)]
            sets.append(np.union1d(base[rng.random(len(base)) < rng.choice([0.7, 0.9, 1])], rng.integers(0, 1 << 63, rng.integers(1, 20), dtype=np.uint64)))
        sides = rng.integers(0, 2, len(sets)) if trial % 2 else None
        i, j = candidate_pairs([signature(x) for x in sets], [len(x) for x in sets], np.arange(len(sets)), sides)
        got = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert len(got) == len(i)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and (sides is None or sides[a] != sides[b]):
                    assert frozenset((a, b)) in got


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)] + [(7, 400 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = plain.roots(450, links)
    linked = {x for p in links for x in p if p[0] != p[1]}
    assert got == {x: root[x] for x in linked}


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*exact.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, got, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert all(plain.gapless(p) and sum(n for _, n in p) <= size for p in by_sequence.values())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(plain_ids(text), "<u4")
        for k, (start, n) in enumerate(packing.pieces_of(len(ids), size)):
            want[doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(by_sequence), -(-sum(n * c for (_, _, _, n, _), c in want.items()) // size)


def test_packing_of_odd_rows(odd_docs):
    used, bound = check_packing(ODD_ROWS, packing.pack(odd_docs, size=256).collect(), 256)
    assert used <= bound + 1


def test_packing_of_generated_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, bound = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect(), 2048)
    assert used <= bound + 1


def test_fast_encoder_agrees_below_its_limit():
    encode = packing.public_encoder()
    rng = random.Random(2)
    letters = [chr(i) for i in range(1, 0x250)]
    for text in ["".join(letters), *("".join(rng.choices(letters + list("  \n\t'abcst019"), k=300)) for _ in range(200))]:
        assert encode(text).tolist() == plain_ids(text)[:-1]


def optimum(items, size):
    """Fewest bins by trying every item in every bin."""
    items = sorted(items, reverse=True)
    best = len(items)

    def put(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(items):
            best = len(room)
            return
        for i in {r: i for i, r in enumerate(room) if r >= items[k]}.values():
            put(k + 1, [*room[:i], room[i] - items[k], *room[i + 1 :]])
        put(k + 1, [*room, size - items[k]])

    put(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.randint(5, 30)
        items = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        plan = bin_completion.complete_bins(dict(Counter(items)), size, most=50)
        assert Counter(x for n, kind in plan for x in kind * n) == Counter(items)
        assert all(sum(kind) <= size for _, kind in plan)
        assert sum(n for n, _ in plan) == optimum(items, size)


def test_dominance():
    assert bin_completion.dominates((5, 3), (4, 3)) and bin_completion.dominates((7,), (4, 3))
    assert not bin_completion.dominates((4, 3), (7,))


def test_long_white_space_is_packed(spark):
    """Runs that overflow the stack of the faster encoder."""
    texts = [" " * 1_000_000, "\n" * 1_000_000, "\t" * 300_000 + "x", "a" + " " * 1000 + "b", "a" + "\r\n" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check_packing(rows, packing.pack(docs).collect(), 2048)
