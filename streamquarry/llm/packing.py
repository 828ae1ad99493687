"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents are tokenised where they lie; only lengths, places and checksums of their pieces move
on.  How many pieces have each length is a table of at most ``size`` rows; ``bin_completion``
finds on it which lengths go together and how many sequences of each kind there are.  Pieces are
ranked within their length and take the place that their rank has in the plan.  Ranks are made
in ``SALTS`` parts per length, so a length that a third of all pieces share spreads over tasks.

Ids are those of ``tokenizers``.  Texts whose characters all lie below U+0250 and that do not
hold a special token's string, nor a run of white space of ``LONG_BLANK`` characters, go through
``tiktoken``, which has the same ranks and pattern and is several times as fast (but overflows its
stack on runs of some hundred thousand); all others go through ``tokenizers`` itself.

Null and empty texts are the end id alone.  Null and repeated ids are carried along.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamquarry.llm.bin_completion import complete_bins
from streamquarry.llm.rows import stored

SALTS = 1024
LONG_BLANK = 1000
_beyond = re.compile(f"[^\x00-ɏ]|\\s{{{LONG_BLANK}}}")


class Encoder:
    """Token ids of texts as arrays of unsigned 32-bit integers."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            pairs = (line.split() for line in lines)
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if _beyond.search(text) or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def public_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)``: full pieces, the first one shorter if they do not come out even."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def cut_documents(docs: DataFrame, id_col: str, text_col: str, size: int, encoder=public_encoder) -> DataFrame:
    """``id, piece, start, length, ids_crc32, salt`` of every piece of every document."""

    def rows(batches):
        encode = encoder()
        for batch in batches:
            texts, out = batch.column(1), [[], [], [], [], []]
            for i in range(batch.num_rows):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), size)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, (i, k, start, length, crc), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), *(pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                ["id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        rows, f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    ).withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(SALTS)))


def _places(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple]:
    """``(length, from_rank, to_rank, per_sequence, first_sequence, offset)`` in the order of the plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, content in plan:
        offset = 0
        for length in sorted(set(content), reverse=True):
            k = content.count(length)
            start = used.get(length, 0)
            rows.append((length, start, start + n * k, k, sequence, offset))
            used[length] = start + n * k
            offset += k * length
        sequence += n
    return rows


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, encoder=public_encoder
) -> DataFrame:
    """A row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, id_col, text_col, size, encoder), "pieces")
    cells = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size rows
    places = spark.createDataFrame(
        _places(complete_bins(counts, size)), "length long, _from long, _to long, _k long, _sequence long, _offset long")
    before = cells.withColumn("_before", F.coalesce(
        F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("_in", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    q = F.col("_before") + F.col("_in") - F.col("_from")
    return (
        ranked.withColumn("_rank", F.col("_before") + F.col("_in"))
        .join(F.broadcast(places), "length")  # rows follow the distinct lengths, not the documents
        .filter("_rank >= _from and _rank < _to")
        .select(
            F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
            (F.col("_sequence") + F.floor(q / F.col("_k"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + (q % F.col("_k")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2``: every document in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the sequences of what is left."""
    return pack(docs)
