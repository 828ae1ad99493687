from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from llm.conftest import ODD_ROWS, table
from pyspark.sql import functions as F

from streamquarry.llm import exact_dedup, sharding
from streamquarry.llm.rows import shared_path


def normal(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def wanted(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r)
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(r[0], best[0], len(own), sha) for r in own]
    return Counter(out)


def test_groups_of_equal_texts(odd_docs):
    got = exact_dedup.dedup_exact(odd_docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == wanted(ODD_ROWS)
    kept = Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({normal(r[1]) for r in ODD_ROWS})


@pytest.mark.parametrize("length", [1, 0])
def test_colliding_digests_are_told_apart_by_bytes(odd_docs, length):
    short = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, length)
    rows = [(i, f"text {i % 40}", None, None, None) for i in range(400)] + ODD_ROWS
    got = exact_dedup.dedup_exact(table(odd_docs.sparkSession, rows), digest=short).collect()
    want = Counter((a, b, n) for (a, b, n, _), k in wanted(rows).items() for _ in range(k))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len({normal(r[1]) for r in rows})


def test_state_goes_on_with_later_files(spark):
    folder, checkpoint = shared_path(spark, "sig"), shared_path(spark, "state")
    states = []
    for part in ([(1, "a", 0, 0, 0), (2, "b", 0, 0, 0)], [(3, "a ", 0, 0, 0), (4, "c", 0, 0, 0)]):
        docs = table(spark, [(i, t, None, None, None) for i, t, *_ in part])
        sig = exact_dedup.signatures(docs, "doc_id", "text", exact_dedup.sha256)
        sig.write.mode("append").parquet(folder)
        state = exact_dedup.ingest(spark, folder, checkpoint, sig.schema, bytes_per_batch=1)
        states.append({(r.best["id"], r.n_rows) for r in state.collect()})
    assert states == [{(1, 1), (2, 1)}, {(3, 2), (2, 1), (4, 1)}]


def test_empty_table(no_docs):
    assert exact_dedup.dedup_exact(no_docs).count() == 0
    assert sharding.shard_rows(no_docs).count() == 0


def test_stage_keeps_columns(spark, odd_docs):
    out = exact_dedup.stage(spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    assert out.count() == len({normal(r[1]) for r in ODD_ROWS})


def test_shards_are_even_and_slots_gapless(odd_docs):
    got = sharding.shard_rows(odd_docs, n_shards=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ODD_ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_overflow_goes_clockwise_and_little_moves(spark):
    docs = table(spark, [(i, str(i), None, None, None) for i in range(4000)])
    at = {}
    for shards in (8, 9):
        got = sharding.shard_rows(docs, n_shards=shards, load_factor=1.25).collect()
        at[shards] = {r.doc_id: (r.shard, r.home) for r in got}
        assert max(Counter(s for s, _ in at[shards].values()).values()) <= -(-4000 * 1.25 // shards)
    home_moves = sum(at[8][i][1] != at[9][i][1] for i in range(4000))
    assert all(at[9][i][1] == 8 for i in range(4000) if at[8][i][1] != at[9][i][1])
    assert sum(at[8][i][0] != at[9][i][0] for i in range(4000)) < home_moves + 1200


def test_walk():
    # three nodes of shards 0, 1, 0; shard 1 is full after its own two
    assert sharding.walk([3, 4, 1], [0, 1, 0], [6, 2]) == [(0, 0, 3, 0), (1, 0, 2, 1), (2, 0, 1, 0), (1, 2, 4, 0)]
