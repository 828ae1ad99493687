"""Tables of a fixed number of places, filled from all rows: counts, or flags of what was seen.

They are small enough to send to every task whatever the size of the data.  As the data grow,
more values share a place; what is read from a table may therefore only save work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16  # places per row while a table is summed


def table_of_places(rows: DataFrame, column: str, to_places, bits: int, flags: bool = False) -> np.ndarray:
    """Counts per place over all rows, or packed bits of the places seen.

    A table per task is added up block by block; its size is fixed by ``bits``.
    """
    block = 1 << min(bits, BLOCK_BITS)
    sent, kept = (np.uint8, np.uint8) if flags else (np.uint16, np.uint32)

    def per_task(batches):
        counts = np.zeros(1 << bits, dtype=bool if flags else np.uint32)
        for batch in batches:
            for places in to_places(batch.column(0)):
                if flags:
                    counts[places] = True
                else:
                    np.add.at(counts, places, 1)
        counts = counts.reshape(-1, block)
        used = np.flatnonzero(counts.any(axis=1))
        cells = [np.packbits(counts[b]) if flags else np.minimum(counts[b], 65535).astype(np.uint16) for b in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([c.tobytes() for c in cells], pa.binary())], ["block", "cells"])

    def merged(table: pa.Table) -> pa.Table:
        total = np.zeros(block >> 3 if flags else block, kept)
        for c in table["cells"]:
            own = np.frombuffer(c.as_buffer(), sent)
            total = total | own if flags else total + own
        return pa.table({"block": table["block"].slice(0, 1), "cells": [total.astype(kept).tobytes()]})

    parts = rows.select(column).mapInArrow(per_task, "block int, cells binary").groupBy("block").applyInArrow(
        merged, "block int, cells binary")
    out = np.zeros(((1 << bits) // block, block >> 3 if flags else block), dtype=kept)
    _fill(out, parts)
    return out.reshape(-1)


def _fill(out: np.ndarray, parts: DataFrame) -> None:
    """The rows ``block, cells`` put into ``out``, all fetched in one job.

    An iterator over partitions runs a job per partition, each with a broadcast of its own on the driver.
    """
    for batch in parts.toArrow().to_batches():
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
            out[block] = np.frombuffer(cells.as_buffer(), out.dtype)


FLAG_BITS = 29  # most places of a table that ``flag_table`` makes: 64 MB
FLAGS_PER_KEY = 3


def _flags_in_block(keys: np.ndarray):
    """Places of a key within its block: its lowest sixteen bits, the next sixteen, and so on."""
    for k in range(FLAGS_PER_KEY):
        yield ((keys >> np.uint64(BLOCK_BITS * k)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def flag_table(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` well mixed 64-bit keys as packed bits; see ``flagged``.

    Sixteen places a key, as long as that are no more than 2 ^ ``FLAG_BITS``.  The top bits of a
    key name its block of places; blocks are filled side by side, each from its own keys.
    """
    bits = min(FLAG_BITS, max(BLOCK_BITS, math.ceil(math.log2(16 * max(1, n)))))
    block = F.shiftrightunsigned(column, 64 - bits + BLOCK_BITS) if bits > BLOCK_BITS else F.lit(0).cast("long")

    def fill(table: pa.Table) -> pa.Table:
        held = np.zeros(1 << BLOCK_BITS, dtype=bool)
        for place in _flags_in_block(table["key"].to_numpy().view(np.uint64)):
            held[place] = True
        return pa.table({"block": table["block"].slice(0, 1), "cells": [np.packbits(held).tobytes()]})

    parts = keys.select(F.col(column).alias("key"), block.alias("block")).groupBy("block").applyInArrow(
        fill, "block long, cells binary")
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for row in parts.toLocalIterator():
        out[row.block] = np.frombuffer(row.cells, np.uint8)
    return out.reshape(-1)


def flagged(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of each key are set: so for all keys of the table, and for one of 200 others."""
    bits = len(table).bit_length() + 2
    keys = keys.view(np.uint64)
    first = (keys >> np.uint64(64 - bits + BLOCK_BITS)).astype(np.int64) << BLOCK_BITS if bits > BLOCK_BITS else np.zeros(len(keys), np.int64)
    found = np.ones(len(keys), dtype=bool)
    for place in _flags_in_block(keys):
        place = first + place
        found &= table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 == 1
    return found
