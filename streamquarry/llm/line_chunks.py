"""Removal of repeated lines by content-defined chunks.

A rolling hash over the hashes of ``WINDOW`` lines in a row decides where a chunk of lines ends,
so boundaries move with the content: lines inserted before a passage change the chunks around
them and no others.  No chunk ends so before it holds ``LEAST`` lines with a word; a line of
``LONG`` words or more is a chunk of its own.  Chunks of several lines and long lines are compared
by hash over all documents; of equal chunks the first stays (smallest id, then address, then
place) and the others are removed, each only after its bytes were compared with those of the
first.  For that the bytes of chunks are gathered whose hash is flagged in a table of repeated
hashes, of fixed size, and joined with the exact list.

Lines end with ``\\n`` and are compared byte for byte; chunks with fewer than two lines that hold
a word are left alone unless that line is long.  So single shorter lines stay, and what of a
passage of shorter lines lies before its first or behind its last boundary.  Null texts count as
empty.  Null ids come last in the order; repeated rows are told apart by their address and lose
their repeated chunks but for the first row's.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.places import table_of_places
from streamquarry.llm.rows import FILE, ROW, addressed, stored
from streamquarry.llm.textarrays import mix, pieces, span_hashes, word_edges

WINDOW = 2  # lines the rolling hash covers
REPEATED_BITS = 26  # places of the table of repeated chunks
ENDS = 3  # a chunk ends at one line in so many
LEAST = 2  # lines with a word that a chunk holds before it ends so
LONG = 50  # words from which a line is a chunk of its own


def chunks_of(data: np.ndarray, offsets: np.ndarray):
    """``starts, ends, text, key, lines`` of all chunks: byte ranges with their last line's end.

    ``lines`` counts the lines with a word, long ones as ``LEAST``: chunks of so many are compared.
    """
    n = len(data)
    newline = np.flatnonzero(data == 10)
    ends = np.union1d(newline + 1, offsets[1:])  # a line ends behind its \n or at the end of its text
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    tail = ends - (data[ends - 1] == 10) if len(ends) else ends  # the last line may lack its \n
    h = span_hashes(data, starts, tail)
    worded = np.zeros(n + 1, np.int64)
    word_starts, _ = word_edges(data, offsets)
    worded[word_starts + 1] = 1
    words_to = np.cumsum(worded)
    words = words_to[ends] - words_to[starts]
    long = words >= LONG
    last = np.ones(len(h), dtype=bool)  # lines that end a chunk whatever its length
    last[:-1] = (text[1:] != text[:-1]) | long[1:] | long[:-1]
    run = np.cumsum(last) - last
    rolling = h.copy()
    for k in range(1, WINDOW):
        before = np.zeros_like(h)  # nothing of another text, nor from beyond a long line
        before[k:] = np.where(run[k:] == run[:-k], h[:-k], np.uint64(0))
        rolling = mix(rolling * np.uint64(0x9E3779B97F4A7C15) + before)
    counted = np.where(long, LEAST, words > 0)
    counted_to = np.cumsum(counted)
    may = np.flatnonzero(last | (rolling % np.uint64(ENDS) == 0))
    closed, base = [], 0
    for line, always, upto in zip(may.tolist(), last[may].tolist(), counted_to[may].tolist(), strict=True):
        if always or upto - base >= LEAST:
            closed.append(line)
            base = upto
    close = np.array(closed, np.int64)
    first = np.concatenate([[0], close[:-1] + 1]).astype(np.int64) if len(close) else close
    key = span_hashes(data, starts[first], tail[close])
    lines = np.add.reduceat(counted, first) if len(first) else first
    return starts[first], ends[close], tail[close], text[first], key, lines, np.bincount(text, minlength=len(offsets) - 1)


def _numbered(text: np.ndarray) -> np.ndarray:
    """Place of each chunk in its text."""
    if not len(text):
        return text
    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    return np.arange(len(text)) - np.repeat(begin, np.diff(np.r_[begin, len(text)]))


def _signatures(batches):
    for batch in batches:
        for start, end, data, offsets in pieces(batch.column(3)):
            _, _, _, text, key, lines, _ = chunks_of(data, offsets)
            keep = lines >= LEAST
            at = pa.array(text[keep] + start)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(3)), pa.array(_numbered(text)[keep].astype(np.int32)),
                 pa.array(key[keep].view(np.int64))], [FILE, ROW, "id", "chunk", "key"])


def _place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - REPEATED_BITS)).astype(np.int64)


def _chunk_texts(flags):
    """Bytes of the compared chunks whose key is flagged, of rows ``file, row, id, text``."""

    def rows(batches):
        for batch in batches:
            for start, _, data, offsets in pieces(batch.column(3)):
                begin, _, tail, text, key, lines, _ = chunks_of(data, offsets)
                at = _place(key.view(np.int64))
                keep = np.flatnonzero((lines >= LEAST) & (flags.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))
                content = [data[s:e].tobytes() for s, e in zip(begin[keep].tolist(), tail[keep].tolist(), strict=True)]
                take = pa.array(text[keep] + start)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(3)), pa.array(_numbered(text)[keep].astype(np.int32)),
                     pa.array(key[keep].view(np.int64)), pa.array(content, pa.binary())], [FILE, ROW, "id", "chunk", "key", "content"])

    return rows


def _without(batches):
    """Rows ``row, text, removed`` with the removed chunks taken out."""
    for batch in batches:
        for start, end, data, offsets in pieces(batch.column(1)):
            begin, stop, _, text, _, _, lines_in = chunks_of(data, offsets)
            first = np.searchsorted(text, np.arange(end - start + 1))
            clean, n_removed, lines_out = [], [], []
            for i in range(end - start):
                gone = set(batch.column(2)[start + i].as_py() or ())
                if not gone:
                    kept = data[offsets[i] : offsets[i + 1]].tobytes()
                else:
                    kept = b"".join(data[begin[c] : stop[c]].tobytes() for c in range(first[i], first[i + 1]) if c - first[i] not in gone)
                    last_gone = first[i + 1] - 1 - first[i] in gone
                    kept = kept.removesuffix(b"\n") if last_gone else kept
                clean.append(kept.decode())
                n_removed.append(len(gone))
                lines_out.append(kept.count(b"\n") + (len(kept) > 0 and not kept.endswith(b"\n")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(clean, pa.string()), pa.array(lines_in.astype(np.int64)),
                 pa.array(lines_out, pa.int64()), pa.array(n_removed, pa.int64())],
                ["row", "clean_text", "n_lines", "n_lines_kept", "n_removed"])


def drop_repeated_chunks(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``row`` (its columns ``carry``), ``clean_text``, ``n_lines``,
    ``n_lines_kept`` and ``n_removed`` chunks."""
    carry = carry or docs.columns
    id_type = docs.schema[id_col].dataType.simpleString()
    read = addressed(docs, *dict.fromkeys([*carry, id_col, text_col]))
    text = F.col(text_col).cast("string").alias("_text")
    signatures = stored(
        read.select(FILE, ROW, F.col(id_col).alias("id"), text).mapInArrow(
            _signatures, f"{FILE} long, {ROW} long, id {id_type}, chunk int, key long"),
        "chunk-keys",
    )
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", FILE, ROW, "chunk")
    repeated = stored(
        signatures.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    flags = docs.sparkSession.sparkContext.broadcast(table_of_places(  # 2 ** REPEATED_BITS bits
        repeated, "key", lambda keys: [_place(keys.to_numpy(zero_copy_only=False))], REPEATED_BITS, flags=True))
    contents = stored(
        read.select(FILE, ROW, F.col(id_col).alias("id"), text).mapInArrow(
            _chunk_texts(flags), f"{FILE} long, {ROW} long, id {id_type}, chunk int, key long, content binary")
        .join(repeated.select("key", "first"), "key").withColumn("head", order == F.col("first")),
        "chunk-texts",
    )
    heads = contents.filter("head").select("key", F.col("content").alias("head_content"))
    removed = stored(
        contents.filter("not head").join(heads, "key").filter("content = head_content")
        .groupBy(FILE, ROW).agg(F.sort_array(F.collect_list("chunk")).alias("removed")),
        "removed",
    )
    packed = read.select(FILE, ROW, F.struct(*carry).alias("row"), text)
    schema = packed.schema["row"].dataType.simpleString()
    # one plan at every size: the removals of all documents are no table to broadcast
    return packed.join(removed.hint("merge"), [FILE, ROW], "left").select("row", "_text", "removed").mapInArrow(
        _without, f"row {schema}, clean_text string, n_lines long, n_lines_kept long, n_removed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9``: every document after the removal of repeated chunks, as lengths and a digest."""
    return drop_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).select(
        "row.doc_id", "n_lines", "n_lines_kept", "n_removed", F.char_length("clean_text").alias("clean_chars"),
        F.sha2("clean_text", 256).alias("clean_sha256"))
