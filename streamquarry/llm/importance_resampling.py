"""Resampling of documents towards a target corpus by hashed n-gram importance weights.

Words are runs of digits, letters and characters beyond ASCII after lower-casing A-Z; everything
else delimits.  The distinct words of a piece of texts form an Aho-Corasick dictionary, each one
bounded by a delimiter on both sides, so a hit is always a whole word; neighbours share the
delimiter between them.  Its payload is the word's CRC-32 and length.  One scan of the automaton
over the piece emits the payloads in order, and the CRC of an n-gram is composed of those of its
adjacent words (a CRC is linear: appending a word shifts the CRC so far by the word's length and
adds the word's own), so no n-gram is ever spelt out.  Words above ``LONG`` bytes would make the
dictionary as large as the text; their payload is computed where they stand.  A dictionary
belongs to one piece of some megabytes, so it never grows with the corpus.

Two scans of the whole table: the first counts features per bucket, the second sums the gains of
the buckets per document.  Only the counts per bucket, a table of fixed size, meet on the driver.
A document's score adds Gumbel noise drawn from its id to its weight, which turns the highest
scores into a sample without replacement.  Ranks come from ranges of the scores, numbered side by
side; ties go to the smaller id.

Null texts have no words.  A null id draws as the empty string and comes last among ties; repeated
rows are ranked each (further ties: number of features, then the row's address).  Other columns
are read only where ``carry`` names them and travel in a struct, so names cannot clash.  An empty
table gives an empty result, an empty target counts as no features.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamquarry.llm.rows import FILE, ROW, addressed, stored
from streamquarry.llm.textarrays import pieces

BUCKETS = 10_000
SEED = "2024"
LONG = 64  # bytes from which a word stays outside the dictionary
PLACE_BITS = 33  # of monotonically increasing ids, the place of a row in its partition

_FOLDED = np.full(256, 32, dtype=np.uint8)  # everything else delimits
_FOLDED[128:] = np.arange(128, 256)
_FOLDED[48:58] = np.arange(48, 58)
_FOLDED[65:91] = _FOLDED[97:123] = np.arange(97, 123)


def _shift_by_one(crc: np.ndarray) -> np.ndarray:
    """CRCs after one more zero byte, without the conditioning at both ends."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return crc


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce([table[j][(crc >> np.uint32(8 * j)) & np.uint32(255)] for j in range(4)])


def _shift_tables(n_bits: int) -> list[np.ndarray]:
    """Tables that append 1, 2, 4, ... zero bytes; each is the one before, applied twice."""
    byte = np.arange(256, dtype=np.uint32)
    tables = [np.stack([_shift_by_one(byte << np.uint32(8 * j)) for j in range(4)])]
    while len(tables) < n_bits:
        tables.append(np.stack([_shifted(tables[-1], row) for row in tables[-1]]))
    return tables


_SHIFTS = _shift_tables(31)


def appended(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of strings followed by others, from both CRCs and the lengths of the latter."""
    crc = crc.copy()
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        own = (length >> k) & 1 == 1
        crc[own] = _shifted(_SHIFTS[k], crc[own])
    return crc ^ more


def _payload(word: bytes) -> int:
    return (len(word) << 32) | zlib.crc32(word)


def word_payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``crc, length`` of all words in order, and where the words of each text begin and end."""
    own = np.insert(_FOLDED[data], offsets, 32)  # a delimiter before each text and behind the last
    begin = offsets + np.arange(len(offsets))
    text = own.tobytes()
    dictionary = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    beyond = False
    for word in set(text.split()):
        if len(word) <= LONG:
            dictionary.add_word(f" {word.decode('latin-1')} ", _payload(word))
        else:
            beyond = True
    hits = np.empty((0, 2), np.int64)
    if len(dictionary):
        dictionary.make_automaton()
        hits = np.fromiter(chain.from_iterable(dictionary.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
    if beyond:
        blank = np.flatnonzero(own == 32)
        at = np.flatnonzero(np.diff(blank) > LONG + 1)
        far = [(e, _payload(text[s + 1 : e])) for s, e in zip(blank[at].tolist(), blank[at + 1].tolist(), strict=True)]
        hits = np.concatenate([hits, np.array(far, np.int64)])
        hits = hits[np.argsort(hits[:, 0])]
    return (hits[:, 1] & 0xFFFFFFFF).astype(np.uint32), hits[:, 1] >> 32, np.searchsorted(hits[:, 0], begin, "right")


def features(data: np.ndarray, offsets: np.ndarray, n_max: int, buckets: int):
    """``bucket, bounds`` for each run length from 1 to ``n_max``; bounds delimit the texts."""
    crc, length, bounds = word_payloads(data, offsets)
    gram = crc
    blank = np.uint32(zlib.crc32(b" "))
    for n in range(1, n_max + 1):
        if n > 1:
            gram = appended(gram[:-1], np.full(max(0, len(gram) - 1), blank), np.ones(max(0, len(gram) - 1), np.int64))
            gram = appended(gram, crc[n - 1 :], length[n - 1 :])
        # runs that reach into the next text are no features
        inside = np.ones(len(gram), dtype=bool)
        for k in range(1, n):
            across = bounds[1:-1] - k
            inside[across[(across >= 0) & (across < len(gram))]] = False
        to = np.concatenate([[0], np.cumsum(inside)])
        yield (gram[inside] % np.uint32(buckets)).astype(np.int64), to[np.minimum(bounds, len(gram))], np.diff(bounds)


def _counter(n_max: int, buckets: int):
    def count(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                for bucket, _, _ in features(data, offsets, n_max, buckets):
                    counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return count


def bucket_counts(table: DataFrame, text_col: str, n_max: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: at most ``buckets`` rows per task, as many in the result."""
    parts = table.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(_counter(n_max, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a nat each: how much more frequent a bucket is in the target, add-one smoothed."""
    s, t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([
        math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k))))
        for a, b in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def _weigher(gain, n_max: int, buckets: int):
    def weigh(batches):
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(1)):
                n, weight, words = 0, 0, None
                for bucket, bounds, words in features(data, offsets, n_max, buckets):
                    sums = np.concatenate([[0], np.cumsum(gain.value[bucket])])
                    n, weight = n + np.diff(bounds), weight + sums[bounds[1:]] - sums[bounds[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(words), pa.array(n), pa.array(weight)],
                    ["row", "n_words", "n_features", "weight"])

    return weigh


def weighed(docs: DataFrame, target: DataFrame, carry: list[str], id_col: str, text_col: str, n_max: int, buckets: int) -> DataFrame:
    """``row`` (file, row, id and the struct ``kept``), ``n_words``, ``n_features`` and ``weight`` per document."""
    gain = gains(bucket_counts(docs, text_col, n_max, buckets), bucket_counts(target, text_col, n_max, buckets))
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept")
    read = addressed(docs, kept, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = read.select(F.struct(FILE, ROW, "id", "kept").alias("row"), "text")
    schema = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(
        _weigher(docs.sparkSession.sparkContext.broadcast(gain), n_max, buckets),
        f"row {schema}, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, carry: list[str] | None = None, percent: int = 10, min_words: int = 20,
    n_max: int = 1, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """A row per document: ``kept`` (its columns ``carry``, all by default), ``n_features``, ``weight``,
    ``score`` and ``rank``, null where it is not among the ``percent`` of a hundred drawn.

    Only documents of ``min_words`` words or more take part in the draw.
    """
    # written before it is ranged: drawing the borders of ranges would scan all texts once more
    found = stored(weighed(docs, target, docs.columns if carry is None else carry, id_col, text_col, n_max, buckets), "weights")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = found.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < min_words)
    order = ["out", F.desc("score"), F.asc_nulls_last("row.id"), "n_features", f"row.{FILE}", f"row.{ROW}"]
    # written once: the borders of the ranges come from sampling and must not be drawn again
    ranged = stored(
        scored.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)),
        "scores")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("out")).cast("long")).alias("n_in"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    eligible = sizes.agg(F.sum("n_in")).first()[0] or 0
    rank = F.col("before") + F.col("place") + 1
    return ranged.join(F.broadcast(shifts), "part").select(
        "row.kept", "n_features", "weight", "score", F.when(rank <= eligible * percent // 100, rank).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op13``: every document with its score, and its rank if a tenth drawn towards ``benchmark`` holds it."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target, ["doc_id"]).select("kept.doc_id", "n_features", "weight", "score", "rank")
