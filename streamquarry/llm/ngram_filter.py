"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs are gathered over all training texts with a shuffle by n-gram.
A count is quantised to a level; the filter holds an n-gram once per level up to its own, so
probing levels upwards until the first miss reads the count back, never too low, and too high
only by false positives.  The filter is built in segments, one group each, and sent to the
workers; its size grows with the counts up to ``max_bits``, beyond which the smallest count that
is stored rises.  Words and pairs of smaller counts are then joined: those of each text that the
filter does not hold meet their counts, which go to the text's row.  The probability of a word interpolates pair and word estimates from such
probes.

The base score uses exact counts: the most frequent words come from a table of at most
``FREQUENT`` rows, all others by a join on the word.

Null texts count as empty: one token, the end.  Null ids count as empty text in the split.
Repeated rows are scored each; rows are told apart by their address.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.rows import FILE, ROW, addressed, landed, stored
from streamquarry.llm.textarrays import combined, mix, pieces, word_hashes

FREQUENT = 1 << 18  # most rows of the broadcast table of word counts
PROBES = 3  # bits of the filter per level
SEGMENTS = 256
BITS_PER_ENTRY = 8
SEEN = 50  # of a word's occurrences, from which its pairs weigh half of what they can
FLUSH = 4 << 20  # n-grams a task holds before it counts and hands on
END, START = np.uint64(0x1111_1111_1111_1110), np.uint64(0x2222_2222_2222_2222)


def _thresholds() -> np.ndarray:
    """Counts at which a level begins: 1, 2, 3, 4, 6, 9 and so on, half as much again each time."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


LEVELS = _thresholds()


def held_out(id_col: str, fold: int, of: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == fold


def _tokens(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """Word ids with the end of each text, and where each text begins; words have even ids."""
    words = word_hashes(data, offsets)
    ids = np.insert(words.hashes & ~np.uint64(1), words.bounds[1:], END)
    return ids, words.bounds + np.arange(len(words.bounds))


def _pairs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Odd ids of each word with the one before it."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + ids) | np.uint64(1)


def _count(batches):
    held: list[np.ndarray] = []
    size = 0

    def flush():
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        for i in range(0, len(grams), 1 << 18):
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[i : i + (1 << 18)].view(np.int64)), pa.array(n[i : i + (1 << 18)])], ["gram", "n"])

    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            ids, bounds = _tokens(data, offsets)
            held += [ids, _pairs(ids, bounds)]
            size += 2 * len(ids)
            if size >= FLUSH:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def count_grams(train: DataFrame, text_col: str, min_pair: int = 1) -> DataFrame:
    """``gram, n``: counts of all words (even ids) and of pairs (odd ids) from ``min_pair`` up."""
    grams = train.select(text_col).mapInArrow(_count, "gram long, n long")
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    return counts if min_pair <= 1 else counts.filter((F.col("gram").bitwiseAND(1) == 0) | (F.col("n") >= min_pair))


def _positions(grams: np.ndarray, level: int, bits_log2: int):
    """Bit of each probe; all probes of an n-gram lie in the segment that its top bits name."""
    within = np.uint64((1 << (bits_log2 - 8)) - 1)
    segment = (grams >> np.uint64(56)) << np.uint64(bits_log2 - 8)
    a = mix(grams + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
    b = (a >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield segment | ((a + np.uint64(k) * b) & within)


def _segment_builder(bits_log2: int):
    def build(table: pa.Table) -> pa.Table:
        size = 1 << (bits_log2 - 8)
        bits = np.zeros(size, dtype=bool)
        grams = table["gram"].to_numpy().view(np.uint64)
        level = np.searchsorted(LEVELS, table["n"].to_numpy(), "right")
        for j in range(1, int(level.max()) + 1):
            for at in _positions(grams[level >= j], j, bits_log2):
                bits[(at & np.uint64(size - 1)).astype(np.int64)] = True
        return pa.table({"segment": table["segment"].slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return build


def build_filter(counts: DataFrame, max_bits: int) -> tuple[np.ndarray, int, int]:
    """The filter's bytes, the logarithm of its bits and the smallest count it holds."""
    level = F.lit(0)
    for t in LEVELS[:60].tolist():
        level = level + F.when(F.col("n") >= t, 1).otherwise(0)
    per_level = {r.level: r.rows for r in counts.withColumn("level", level).groupBy("level").agg(F.count(F.lit(1)).alias("rows")).collect()}
    lowest, entries = 1, sum(k * n for k, n in per_level.items())
    while entries * 4 > max_bits:
        entries -= lowest * per_level.get(lowest, 0)
        lowest += 1
    bits_log2 = max(16, min(int(math.log2(max_bits)), math.ceil(math.log2(max(1, entries * BITS_PER_ENTRY)))))
    floor = int(LEVELS[lowest - 1])
    segments = (
        counts.filter(F.col("n") >= floor)
        .withColumn("segment", F.shiftrightunsigned("gram", 56).cast("int"))
        .groupBy("segment").applyInArrow(_segment_builder(bits_log2), "segment int, bits binary")
    )
    held = np.zeros((SEGMENTS, 1 << (bits_log2 - 11)), dtype=np.uint8)
    for row in segments.toLocalIterator():  # max_bits / 8 bytes in all
        held[row.segment] = np.frombuffer(row.bits, dtype=np.uint8)
    return held.reshape(-1), bits_log2, floor


def read_levels(held: np.ndarray, bits_log2: int, grams: np.ndarray) -> np.ndarray:
    """The highest level each n-gram reaches without a miss, 0 if it is not held."""
    level = np.zeros(len(grams), dtype=np.int64)
    left = np.arange(len(grams))
    for j in range(1, len(LEVELS)):
        found = np.ones(len(left), dtype=bool)
        for at in _positions(grams[left], j, bits_log2):
            found &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        left = left[found]
        if not len(left):
            break
        level[left] = j
    return level


_LEAST = np.concatenate([[0], LEVELS])  # smallest count of a level
_MOST = np.concatenate([[0], LEVELS[1:] - 1, LEVELS[-1:]])  # largest


def _missed(model):
    """``file, row, gram``: the words and pairs of each text ``file, row, text`` that the filter does not hold."""

    def rows(batches):
        m = model.value
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(2)):
                ids, bounds = _tokens(data, offsets)
                distinct, place = np.unique(np.concatenate([ids, _pairs(ids, bounds)]), return_inverse=True)
                text = np.tile(np.repeat(np.arange(end - start), np.diff(bounds)), 2)
                none = (read_levels(m["filter"], m["bits_log2"], distinct) == 0)[place]
                keys = np.unique(text[none] * len(distinct) + place[none])
                at = pa.array(start + keys // max(1, len(distinct)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     pa.array(distinct.view(np.int64)[keys % max(1, len(distinct))])], [FILE, ROW, "gram"])

    return rows


def _with_rest(texts: DataFrame, rest: DataFrame, model) -> DataFrame:
    """``texts`` with the counts ``rest`` of their words and pairs that the filter leaves out, as ``low``, ``low_n``."""
    found = (
        texts.select(FILE, ROW, "text").mapInArrow(_missed(model), f"{FILE} long, {ROW} long, gram long")
        .join(rest, "gram").groupBy(FILE, ROW).agg(F.collect_list(F.struct("gram", "n")).alias("low"))
    )
    return texts.join(found, [FILE, ROW], "left").withColumns({"low": F.col("low.gram"), "low_n": F.col("low.n")})


def _scorer(model):
    """Scores of batches of ``file, row, id, held_out, text`` and maybe ``low, low_n``; ``model`` is a broadcast dict."""

    def of_texts(data, offsets, m, low, low_level):
        def levels(grams):
            level = read_levels(m["filter"], m["bits_log2"], grams)
            if len(low):
                at = np.minimum(np.searchsorted(low, grams), len(low) - 1)
                level = np.where((level == 0) & (low[at] == grams), low_level[at], level)
            return level

        ids, bounds = _tokens(data, offsets)
        begin = bounds[:-1]
        distinct, place = np.unique(ids, return_inverse=True)
        signed = distinct.view(np.int64)
        at = np.minimum(np.searchsorted(m["words"], signed), len(m["words"]) - 1)
        frequent = m["words"][at] == signed if len(m["words"]) else np.zeros(len(signed), bool)
        exact = np.where(frequent, m["counts"][at] if len(m["words"]) else 0, 0)
        smooth = math.log10(m["n"] + m["v"] + 1)
        base = np.where(frequent, np.log10(exact + 1), 0.0)[place] - smooth

        word = levels(distinct)[place]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[begin] = np.searchsorted(LEVELS, m["texts"], "right")
        pair = levels(_pairs(ids, bounds))
        alone = (_LEAST[word] + 1) / (m["n"] + m["v"] + 1)
        of_pair = np.minimum(_LEAST[pair], _MOST[context]) / np.maximum(_MOST[context], 1)
        weight = m["weight"] * _LEAST[context] / (_LEAST[context] + SEEN)
        p = weight * of_pair + (1 - weight) * alone

        text = np.repeat(np.arange(len(begin)), np.diff(bounds))
        rare = ~frequent[place]
        keys, tf = np.unique(text[rare] * len(distinct) + place[rare], return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(begin) + 1) * len(distinct))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
        return [
            pa.array(np.diff(bounds)),
            pa.array(np.add.reduceat(frequent[place].astype(np.int64), begin)),
            pa.array(np.add.reduceat(base, begin)),
            pa.array(np.add.reduceat(np.log10(p), begin)),
            lists(signed[keys % max(1, len(distinct))]), lists(tf.astype(np.int64)),
        ]

    def score(batches):
        m = model.value
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(4)):
                own = [batch.column(i).slice(start, end - start) for i in range(4)]
                low, n = np.empty(0, np.uint64), np.empty(0, np.int64)
                if batch.num_columns > 5:
                    # a count holds for every text, so those of all texts of a piece are read together
                    low, n = (batch.column(i).slice(start, end - start).flatten().to_numpy() for i in (5, 6))
                    low, first = np.unique(low.view(np.uint64), return_index=True)
                    n = n[first]
                yield pa.RecordBatch.from_arrays(
                    own + of_texts(data, offsets, m, low, np.searchsorted(LEVELS, n, "right")), SCORED)

    return score


SCORED = [FILE, ROW, "id", "held_out", "n_tokens", "known", "base", "score", "rare", "rare_n"]


def score_texts(
    docs: DataFrame,
    in_train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 1 << 30,
    pair_weight: float = 0.4,
) -> DataFrame:
    """A row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark, docs = docs.sparkSession, landed(docs)
    counts = stored(count_grams(docs.filter(in_train), text_col), "gram-counts")
    words = counts.filter(F.col("gram").bitwiseAND(1) == 0)
    end = words.filter(F.col("gram") == int(END)).agg(F.sum("n")).first()[0] or 0
    size = words.agg(F.sum("n"), F.count(F.lit(1))).first()

    # the counts from which at most FREQUENT words are left, by eighths of a doubling
    steps = words.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    left, floor = FREQUENT, 1 << 62
    for step in sorted(steps, reverse=True):
        left -= step.rows
        if left < 0:
            break
        floor = 2 ** (step.step / 8)
    top = words.filter(F.floor(8 * F.log2("n")) >= round(8 * math.log2(floor))).toArrow().sort_by("gram")
    held, bits_log2, least = build_filter(counts, max_bits)
    model = spark.sparkContext.broadcast({
        "words": top["gram"].to_numpy(), "counts": top["n"].to_numpy(), "n": size[0] or 0, "v": size[1],
        "texts": end, "filter": held, "bits_log2": bits_log2, "weight": pair_weight,
    })

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = addressed(docs, id_col, text_col).select(
        FILE, ROW, F.col(id_col).alias("id"), (~in_train).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if least > 1:
        texts = _with_rest(texts, counts.filter(F.col("n") < least), model)
    scored = stored(
        texts.mapInArrow(_scorer(model), f"{FILE} long, {ROW} long, id {id_type}, held_out boolean, n_tokens long, "
                    "known long, base double, score double, rare array<long>, rare_n array<long>"),
        "scored",
    )
    rare = (
        scored.select(FILE, ROW, F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
        .select(FILE, ROW, F.col("x.rare").alias("gram"), F.col("x.rare_n").alias("tf"))
        .join(words, "gram")
        .groupBy(FILE, ROW)
        .agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more"), F.sum("tf").alias("more_known"))
    )
    zero = F.lit(0)
    return scored.join(rare, [FILE, ROW], "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(size[0] or 0).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10``: every document under the model of those whose checksum is not 2 modulo 7."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out("doc_id", 2, 7))
