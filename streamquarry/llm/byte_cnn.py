"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

A text is cut into overlapping chunks that cover all of it.  In a chunk every byte becomes a
learned vector, learned filters slide over the vectors, and the strongest response of each
filter is kept (max-pooling).  A second layer turns the responses of a chunk into hidden units;
the mean and the maximum of the chunks' units are combined into one probability.  Documents of
any length are scored whole.

The network is fitted on the driver on at most ``SAMPLE`` labelled documents, of which it sees
random chunks in every step, and sent to the workers (some ten thousand numbers).

Null texts count as empty; an empty text is one chunk of padding and gets a score like any
other.  Null ids count as empty text in the split and may repeat.  Without usable labels the
score is 0.5.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.ngram_filter import held_out
from streamquarry.llm.textarrays import pieces

SAMPLE = 4096  # labelled documents the network is fitted on, at most
SAMPLE_BYTES = 32 << 20  # of their texts, at most; longer ones give a random stretch
CHUNK, STEP = 512, 384  # bytes of a chunk, and from one chunk to the next
BAD_WEIGHT = 2  # of a bad document in the loss, so that the classes part near a score of 0.3
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 32, 16


def new_network(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": normal(257, EMBED, scale=0.5),  # the last row is padding
        "filters": normal(WIDTH * EMBED, FILTERS, scale=0.25), "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS, HIDDEN, scale=0.25), "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(2 * HIDDEN, scale=0.25), "out_bias": np.zeros(1, np.float32),
    }


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks that together cover ``n`` bytes."""
    return np.arange(0, max(1, n - (CHUNK - STEP)), STEP)


def _windows(net, chunks: np.ndarray) -> np.ndarray:
    """Embedded bytes under each filter position: ``chunks, positions, WIDTH * EMBED``."""
    embedded = net["embed"][chunks].reshape(len(chunks), -1)
    flat = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)
    return flat[:, :: STRIDE * EMBED]


def chunk_units(net, chunks: np.ndarray) -> np.ndarray:
    """Hidden units of each chunk."""
    x = np.ascontiguousarray(_windows(net, chunks))
    pooled = (x.reshape(-1, WIDTH * EMBED) @ net["filters"]).reshape(len(chunks), -1, FILTERS).max(axis=1)
    return np.maximum(np.maximum(pooled + net["filter_bias"], 0) @ net["hidden"] + net["hidden_bias"], 0)


def _probability(net, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(np.concatenate([mean, most], axis=1) @ net["out"] + net["out_bias"])))


def score_texts(net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of good quality of each text."""
    starts = [chunk_starts(n) for n in np.diff(offsets).tolist()]
    of_text = np.concatenate([[0], np.cumsum([len(s) for s in starts])])
    begin = np.concatenate([s + o for s, o in zip(starts, offsets[:-1].tolist(), strict=True)])
    end = np.repeat(offsets[1:], np.diff(of_text))
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    units = np.empty((len(begin), HIDDEN), np.float32)
    for s in range(0, len(begin), 128):
        at = begin[s : s + 128, None] + np.arange(CHUNK)
        chunks = np.where(at < end[s : s + 128, None], padded[np.minimum(at, len(padded) - 1)].astype(np.int16), 256)
        units[s : s + 128] = chunk_units(net, chunks)
    mean = np.add.reduceat(units, of_text[:-1], axis=0) / np.diff(of_text)[:, None]
    return _probability(net, mean, np.maximum.reduceat(units, of_text[:-1], axis=0)).astype(np.float64)


def _gradients(net, chunks: np.ndarray, docs: int, label: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted logistic loss; ``chunks`` holds the same number for each document."""
    n, per = len(chunks), len(chunks) // docs
    x = np.ascontiguousarray(_windows(net, chunks))
    responses = (x.reshape(-1, WIDTH * EMBED) @ net["filters"]).reshape(n, -1, FILTERS)
    at = responses.argmax(axis=1)
    pooled = np.take_along_axis(responses, at[:, None], axis=1)[:, 0] + net["filter_bias"]
    active = np.maximum(pooled, 0)
    hidden = active @ net["hidden"] + net["hidden_bias"]
    units = np.maximum(hidden, 0).reshape(docs, per, HIDDEN)
    top = units.argmax(axis=1)
    both = np.concatenate([units.mean(axis=1), units.max(axis=1)], axis=1)
    p = 1 / (1 + np.exp(-(both @ net["out"] + net["out_bias"])))
    error = ((p - label) * weight / docs).astype(np.float32)
    g = {"out": both.T @ error, "out_bias": error.sum(keepdims=True)}
    d_both = error[:, None] * net["out"]
    d_units = np.repeat(d_both[:, None, :HIDDEN] / per, per, axis=1)
    np.put_along_axis(d_units, top[:, None], np.take_along_axis(d_units, top[:, None], axis=1) + d_both[:, None, HIDDEN:], axis=1)
    d_hidden = d_units.reshape(n, HIDDEN) * (hidden > 0)
    g["hidden"], g["hidden_bias"] = active.T @ d_hidden, d_hidden.sum(axis=0)
    d_pooled = (d_hidden @ net["hidden"].T) * (pooled > 0)
    g["filter_bias"] = d_pooled.sum(axis=0)
    chosen = np.take_along_axis(x, at[:, :, None], axis=1)  # chunks, filters, window
    g["filters"] = np.einsum("nf,nfw->wf", d_pooled, chosen)
    d_window = d_pooled[:, :, None] * net["filters"].T
    where = (at * STRIDE)[:, :, None] + np.arange(WIDTH)
    values = np.take_along_axis(chunks[:, None, :], where.reshape(n, 1, -1), axis=2).reshape(-1)
    d_embed = d_window.reshape(-1, EMBED)
    g["embed"] = np.stack([np.bincount(values, d_embed[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
    return g, float(-(weight * np.where(label == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).mean())


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 700, batch: int = 48, per: int = 3, rate: float = 4e-3, seed: int = 7):
    """Fit with Adam; every step sees ``per`` random chunks of ``batch`` documents, classes even."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    groups = [np.flatnonzero(labels == k) for k in (0, 1)]
    if min(map(len, groups)) == 0:
        return {k: np.zeros_like(v) for k, v in net.items()}
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        chunks = np.full((batch * per, CHUNK), 256, np.int16)
        for i, r in enumerate(rows.tolist()):
            starts = chunk_starts(len(texts[r]))
            for k, s in enumerate(rng.choice(starts, per)):
                own = np.frombuffer(texts[r], np.uint8)[s : s + CHUNK]
                chunks[i * per + k, : len(own)] = own
        g, _ = _gradients(net, chunks, batch, labels[rows].astype(np.float32), np.where(labels[rows] == 1, 1, BAD_WEIGHT).astype(np.float32))
        for k in net:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            move = rate * min(1.0, 4 * (1 - t / (steps + 1)))
            net[k] = (net[k] - move * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _sampled(docs: DataFrame, labels: DataFrame, in_train: Column, id_col: str, text_col: str, sample: int):
    """Texts and labels of at most ``sample`` documents, chosen by a hash of their ids."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
        .filter(F.col("label").isin(0, 1) & in_train).orderBy(F.xxhash64("_id"), "label").limit(sample)
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    longest = SAMPLE_BYTES // sample
    start = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - longest + 1)).cast("int")
    found = docs.select(F.col(id_col).alias("_id"), F.substr(text, start + 1, F.lit(longest)).cast("binary").alias("text")).join(
        F.broadcast(chosen), "_id").select("_id", "label", "text").dropDuplicates(["_id"]).toArrow().sort_by([("_id", "ascending"), ("label", "ascending")])
    return found["text"].to_pylist(), found["label"].to_numpy()


def _scorer(net):
    def rows(batches):
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(score_texts(net.value, data, offsets))], ["id", "score"])

    return rows


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, steps: int = 700
) -> DataFrame:
    """A row per document: ``id, score``; labels of ids whose checksum is 0 modulo 5 are not seen."""
    texts, marks = _sampled(docs, labels, ~held_out("_id", 0, 5), id_col, text_col, sample)
    net = docs.sparkSession.sparkContext.broadcast(fit(texts, marks, steps))
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        _scorer(net), f"id {id_type}, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3``: the quality of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels).select(
        "doc_id", held_out("doc_id", 0, 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
