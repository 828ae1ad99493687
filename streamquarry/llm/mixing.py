"""Mixing documents to target weights of domains, with soft membership.

A classifier learned from the labelled table gives every document a probability per domain.
Each document gets a rate that is not negative; a domain's expected tokens are the sum of
rate * tokens * probability.  The rates solve a least-squares problem, expected against wanted
tokens, by projected gradients from the rate 1 on, so documents change no more than needed.

A posterior is not certain even of a document whose domain is known, and the less so the more
words a corpus has that the labelled table lacks.  So the classifier is held against labelled
documents it was not fitted on: their mean posterior per token, by domain, says what the expected
tokens of a mixture on target look like, and these are what the rates are fitted to.  A corpus of
clean documents then counts as clean, however soft the classifier.

Domains are few.  A step needs the expected tokens per domain under the present rates, one
aggregation over all documents, and moves the rate of a document by the product of its
probabilities with one vector (gradients are taken per token, and the residual is weighted by
the inverse of the domains' second moments over the documents whose rate is not 0).  The rate is therefore an
expression over the probabilities and the vectors so far: nothing per document is kept between
steps, and lost work is simply computed again.  Steps end when the targets are met.  Where no
rates up to ``MOST_RATE`` meet them (few rows, or a classifier that cannot tell the domains apart),
the wanted shares are moved halfway back to the present ones, and again, so that documents are
never traded for a few copied many times; a warning names the part of the way that is left.

Null and empty texts have no words: the classifier gives them the prior and they count one
token, the end.  Without labels the probabilities are even.  Null and repeated ids are carried
along; of the rows of a labelled id the least text is learned from.  Empty tables give empty results.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.ngram_filter import held_out
from streamquarry.llm.rows import stored
from streamquarry.llm.textarrays import mix, pieces, word_edges, word_hashes

DOMAINS = ["clean", "junk", "toxic"]
WEIGHTS = {"clean": 0.96, "junk": 0.02, "toxic": 0.02}
FEATURE_BITS = 16
SAMPLE = 2048  # labelled documents the classifier is fitted and calibrated on, at most
CALIBRATE = 4  # one in so many of them is held out of the fit, to see what posteriors its domain gets
PATIENCE = 10  # steps that gain less than a tenth, after which no rates are taken to meet the targets
MOST_RATE = 2.0
HALVINGS = 6  # of the way to the targets, after which rates stay 1


def _features(data, offsets) -> list[np.ndarray]:
    """Distinct hashed words and word endings of each text."""
    words = word_hashes(data, offsets)
    ends = word_edges(data, offsets)[1]
    padded = np.concatenate([np.zeros(2, np.uint8), data]).astype(np.uint64)
    last = ends + 1  # of the last byte, behind the padding
    tail = (padded[last] << np.uint64(8)) | padded[last - 1]
    shift = np.uint64(64 - FEATURE_BITS)
    whole, end = (mix(words.hashes) >> shift), (mix(tail + np.uint64(1 << 40)) >> shift)
    b = words.bounds
    return [np.unique(np.concatenate([whole[s:e], end[s:e]])).astype(np.int32) for s, e in zip(b[:-1], b[1:], strict=True)]


def _labelled_features(batches):
    for batch in batches:
        for start, end, data, offsets in pieces(batch.column(1)):
            tokens = np.diff(word_hashes(data, offsets).bounds) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(tokens),
                 pa.array(_features(data, offsets), pa.list_(pa.int32()))], ["domain", "n_tokens", "features"])


def _probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _scores(weights, bias, flat, doc, scale, n_texts):
    """Scores per text; ``doc`` and ``scale`` are the text of each feature and its weight there."""
    sums = [np.bincount(doc, weights[flat, k] * scale, n_texts) for k in range(weights.shape[1])]
    return np.stack(sums, axis=1) + bias


def _places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(bounds)
    return np.repeat(np.arange(len(n), dtype=np.int32), n), np.repeat(1 / np.sqrt(np.maximum(1, n)), n)


def _flat(features: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = features.combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)


def confusion(labelled: pa.Table, model, n_domains: int) -> np.ndarray:
    """Row k: the mean posterior per token of documents of domain k; of a domain without any, its own."""
    out = np.eye(n_domains)
    if not labelled.num_rows:
        return out
    flat, bounds = _flat(labelled["features"])
    p = _probabilities(_scores(*model, flat, *_places(bounds), labelled.num_rows))
    tokens, domain = labelled["n_tokens"].to_numpy(), labelled["domain"].to_numpy()
    for k in np.unique(domain):
        out[k] = np.average(p[domain == k], axis=0, weights=tokens[domain == k])
    return out


def fit_classifier(labelled: pa.Table, n_domains: int, rounds: int = 100, rate: float = 8.0, decay: float = 1e-5):
    """Weights and bias of a softmax over hashed features; Nesterov steps on all rows."""
    weights, bias = np.zeros((1 << FEATURE_BITS, n_domains)), np.zeros(n_domains)
    if not labelled.num_rows:
        return weights, bias
    flat, bounds = _flat(labelled["features"])
    wanted = np.eye(n_domains)[labelled["domain"].to_numpy()]
    doc, scale = _places(bounds)
    w_before, b_before = weights, bias
    for t in range(rounds):
        ahead = t / (t + 3)
        w, b = weights + ahead * (weights - w_before), bias + ahead * (bias - b_before)
        error = (_probabilities(_scores(w, b, flat, doc, scale, len(wanted))) - wanted) / len(wanted)
        grad = np.stack([np.bincount(flat, scale * error[doc, k], 1 << FEATURE_BITS) for k in range(n_domains)], axis=1)
        w_before, b_before = weights, bias
        weights, bias = w - rate * (grad + decay * w), b - rate * error.sum(axis=0)
    return weights, bias


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def _classified(model, n_domains: int):
    def rows(batches):
        weights, bias = model.value
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(1)):
                lists = _features(data, offsets)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                p = _probabilities(_scores(weights, bias, np.concatenate(lists), *_places(bounds), len(lists)))
                tokens = np.diff(word_hashes(data, offsets).bounds) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(tokens), *(pa.array(p[:, k]) for k in range(n_domains))],
                    ["row", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    return rows


def learned(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", sample: int = SAMPLE):
    """``(weights, bias)`` of the classifier, and its confusion on labelled documents left out of the fit."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
        .filter(F.col("domain").isNotNull() & ~held_out("_id", 0, 5)).orderBy(F.xxhash64("_id"), "domain").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    # one text of an id, so no more than the sample are collected
    texts = texts.groupBy("_id").agg(F.min("domain").alias("domain"), F.min("text").alias("text"))
    labelled = texts.select("domain", "text").mapInArrow(_labelled_features, "domain int, n_tokens long, features array<int>").toArrow()
    # by content, so that every run learns from the same rows in the same order
    first = pa.array([x[0] if x else -1 for x in labelled["features"].to_pylist()], pa.int32())
    labelled = labelled.append_column("first", first).sort_by([(c, "ascending") for c in ("domain", "n_tokens", "first")])
    out = np.arange(labelled.num_rows) % CALIBRATE == CALIBRATE - 1
    model = fit_classifier(labelled.filter(pa.array(~out)), len(DOMAINS))
    return model, confusion(labelled.filter(pa.array(out)), model, len(DOMAINS))


def with_domains(docs: DataFrame, model, carry: list[str], text_col="text") -> DataFrame:
    """``row`` (the columns ``carry``), ``n_tokens`` and a probability per domain for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** FEATURE_BITS rows
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(
        _classified(sent, len(DOMAINS)), f"row {schema}, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def _totals(members: DataFrame, *more: Column) -> np.ndarray:
    values = members.agg(*more).first()
    return np.array([v or 0.0 for v in values])


def fit_rates(
    members: DataFrame, weights: dict[str, float], known: np.ndarray | None = None, total: float | None = None,
    tolerance: float = 1e-4,
):
    """Vectors that take the rate from 1 to the solution, see ``rate_of``; wanted and reached tokens.

    ``members`` has ``n_tokens`` and the probabilities.  ``known`` is the classifier's confusion, none
    if posteriors are taken as they are.  Without ``total`` the wanted tokens are such that the
    domain of the largest weight keeps what it has.
    """
    p, tokens = [F.col(f"p_{d}") for d in DOMAINS], F.col("n_tokens")
    share = np.array([weights[d] for d in DOMAINS]) / sum(weights.values())
    share = share if known is None else share @ known
    present = _totals(members, *(F.sum(tokens * x) for x in p))
    if not present.sum():
        return [], present, present
    present_share, main = present / present.sum(), int(share.argmax())
    for halving in range(HALVINGS + 1):
        aim = present_share + (share - present_share) / 2**halving
        wanted = aim * (present[main] / aim[main] if total is None else total)
        path, expected = _descent(members, wanted, tolerance)
        if path is not None:
            if halving:
                warnings.warn(f"no rates meet the target weights: {1 / 2**halving:g} of the way is gone", stacklevel=2)
            return path, wanted, expected
    warnings.warn("no rates meet the target weights: rates stay 1", stacklevel=2)
    return [], wanted, present


def _descent(members: DataFrame, wanted: np.ndarray, tolerance: float):
    """Vectors and reached tokens of projected-gradient steps, no vectors if the wanted tokens are out of reach."""
    p, tokens, rate = [F.col(f"p_{d}") for d in DOMAINS], F.col("n_tokens"), F.col("rate")
    path, gaps = [], []
    while True:
        # as a column of its own: the sums would each repeat the vectors so far, in a plan that grows with every step
        values = _totals(members.select(tokens, *p, rate_of(path).alias("rate")), F.max(rate), *(F.sum(rate * tokens * x) for x in p),
                         *(F.sum(F.when(rate > 0, tokens * x * y)) for x in p for y in p))
        largest, expected, gram = values[0], values[1 : len(p) + 1], values[len(p) + 1 :].reshape(len(p), len(p))
        gaps.append(float(np.abs(expected - wanted).sum() / wanted.sum()))
        if gaps[-1] <= tolerance:
            return (path if largest <= MOST_RATE else None), expected
        if len(gaps) > PATIENCE and not min(gaps[-PATIENCE:]) <= 0.9 * min(gaps[:-PATIENCE]):
            return None, expected
        path.append((np.linalg.pinv(gram, rcond=1e-10) @ (expected - wanted)).tolist())


def rate_of(path: list[list[float]]) -> Column:
    """A document's rate after the steps in ``path``, each projected onto what is not negative."""
    if not path:
        return F.lit(1.0)
    steps = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in vector) + ")" for vector in path) + ")")

    def step(rate: Column, vector: Column) -> Column:
        move = sum((F.col(f"p_{d}") * vector[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - move)

    return F.aggregate(steps, F.lit(1.0), step)


def mixed(
    docs: DataFrame, labels: DataFrame, carry: list[str], weights: dict[str, float] = WEIGHTS, id_col="doc_id", text_col="text",
    sample: int = SAMPLE,
) -> DataFrame:
    """``row, n_tokens, p_*, rate, copies``: ``copies`` is the rate rounded by a hash of the row."""
    model, known = learned(docs, labels, id_col, text_col, sample)
    members = stored(with_domains(docs, model, carry, text_col), "members")
    path, _, _ = fit_rates(members, weights, known)
    chance = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / (1 << 30)
    return members.withColumn("rate", rate_of(path)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4``: every document's domains, rate and copies."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixed(docs, labels, ["doc_id"]).select(
        "row.doc_id", "n_tokens", *(F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS),
        F.round("rate", 6).alias("rate"), "copies",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents stay with the probability of their rate, once if it is above 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed(docs, labels, docs.columns).filter("copies > 0").select("row.*")
