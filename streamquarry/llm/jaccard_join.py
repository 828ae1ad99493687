"""Join of similar documents: Jaccard similarity of word shingles by signature trees.

Documents with equal shingle sets form a class; all work below is on one set per class.

1. Shingles are counted in a table of fixed size, which gives each shingle a level: 0 for the
   ordinary ones, more the more common its place in the table is.  Ordering shingles by level
   and then by hash is the same for all documents, so two sets similar enough share one of the
   first ``n - ceil(t * n) + 1`` of each (prefix filter), and a passage that many documents
   share comes last and joins nobody.
2. Classes that share one of their first shingles are tried against one class of that group,
   and the links found are joined to components.
3. All prefix shingles that lie in more than one component are gathered, and a signature tree
   over the classes of each is traversed against itself; only pairs from different components
   that the bounds allow are left.  A group no larger than a leaf needs no tree: its pairs meet
   the bound after repeated ones are dropped.  Pairs of such and of somewhat larger groups are
   checked by a join with the sets; large groups, cut into blocks so that no task holds more than two, check theirs at once and
   skip what a link just found has joined.
4. Components of all links.

Every pair of classes in different components that can reach the threshold is checked on the
whole sets, so components are exact, up to collisions of 64-bit hashes.  Levels and first
links only save work.

Null texts count as empty; texts without words form no links.  Null ids give way to others in
``component_id``.  Repeated rows are copies.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.components import components
from streamquarry.llm.places import table_of_places
from streamquarry.llm.rows import FILE, ROW, addressed, landed, stored
from streamquarry.llm.signature_tree import LEAF, candidate_pairs, leaf_bound, signature
from streamquarry.llm.textarrays import combined, mix, pieces, word_hashes
from streamquarry.plans.workspace import delete_steps, write_step

TABLE_BITS = 22  # places of the table of shingle counts
FIRST = 8  # shingles by which classes are tried first
LARGE = 64  # classes of a group from which it checks its own pairs
BLOCK = 4096  # classes of a large group that a task holds per side
WANTED_BITS = 26  # places of the filter that selects sets


def shingle_sets(data, offsets, n_words: int):
    """The sorted distinct shingles of each text."""
    words = word_hashes(data, offsets)
    runs = combined(words.hashes, n_words)
    for start, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if end - start >= n_words:
            x = np.sort(runs[start : end - n_words + 1])  # faster here than np.unique
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif end > start:
            yield combined(words.hashes[start:end], end - start)
        else:
            yield np.empty(0, np.uint64)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_levels(docs: DataFrame, text_col: str, n_words: int) -> np.ndarray:
    """One byte per place of the table: how common the shingles there are, 0 for most."""
    shift = np.uint64(64 - TABLE_BITS)

    def places(column):
        for _, _, data, offsets in pieces(column):
            sets = list(shingle_sets(data, offsets, n_words))
            yield (np.concatenate(sets) >> shift).astype(np.int64) if sets else np.empty(0, np.int64)

    counts = table_of_places(docs, text_col, places, TABLE_BITS)
    mean = counts.mean()
    usual = mean + 6 * mean**0.5 + 8
    levels = np.zeros(len(counts), np.uint8)
    common = np.flatnonzero(counts >= usual)  # few of the places: the driver holds no wider copies of the table
    levels[common] = (np.floor(2 * np.log2(np.maximum(counts[common], 1) / usual)) + 1).astype(np.uint8)
    return levels


def _class_rows(levels, n_words: int, num: int, den: int):
    shift = np.uint64(64 - TABLE_BITS)

    def rows(batches):
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(1)):
                out = [[], [], [], []]
                for x in shingle_sets(data, offsets, n_words):
                    order = np.lexsort((x, levels.value[(x >> shift).astype(np.int64)]))
                    keep = len(x) - -(-num * len(x) // den) + 1 if len(x) else 0
                    for column, value in zip(out, (class_of(x) if len(x) else None, len(x), x[order[:keep]].view(np.int64), signature(x) if len(x) else None), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())],
                    ["row", "class", "n", "prefix", "bits"])

    return rows


def _wanted_sets(docs: DataFrame, text_col: str, n_words: int, wanted: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``class, set`` for the classes in ``wanted``, texts are hashed again; and what was sent for it."""
    shift = np.uint64(64 - WANTED_BITS)
    place = lambda c: (mix(c.view(np.uint64)) >> shift).astype(np.int64)
    bits = table_of_places(wanted, "class", lambda column: [place(column.to_numpy(zero_copy_only=False))], WANTED_BITS, flags=True)
    chosen = docs.sparkSession.sparkContext.broadcast(bits)  # 2 ** WANTED_BITS bits

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                classes, sets = [], []
                for x in shingle_sets(data, offsets, n_words):
                    c = class_of(x)
                    p = int(place(np.array([c], np.int64))[0])
                    if len(x) and chosen.value[p >> 3] >> (7 - (p & 7)) & 1 and c not in seen:
                        seen.add(c) if len(seen) < 1 << 20 else None
                        classes.append(c)
                        sets.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "set"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(rows, "class long, set binary")
    return found.join(wanted, "class", "left_semi").dropDuplicates(["class"]), chosen


def _similar(x: bytes, y: bytes, num: int, den: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _classes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that reach the threshold on their whole sets."""

    def check(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [_similar(x[i].as_py(), y[i].as_py(), num, den) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda name: sets.select(F.col("class").alias(name), F.col("set").alias(f"set_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _groups(batches, key_columns: int):
    """Record batches sorted by their first columns, as one table per key."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if key is not None and (keys[s] != key).any():
                yield pa.Table.from_batches(held)
                held = []
            key = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _crossing(batches):
    """Of rows ``token, class, label`` sorted by token: those of tokens in several components."""
    names = ["token", "class", "label", "size"]
    rest = None
    for batch in batches:
        block = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            block = [np.concatenate(x) for x in zip(rest, block, strict=True)]
        last = int(np.searchsorted(block[0], block[0][-1], "left")) if len(block[0]) else 0
        rest = [x[last:] for x in block]
        yield from _crossing_rows([x[:last] for x in block], names)
    if rest is not None:
        yield from _crossing_rows(rest, names)


def _crossing_rows(block, names):
    token, _, label = block
    if len(token):
        at = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[at, len(token)])
        keep = np.repeat(np.minimum.reduceat(label, at) < np.maximum.reduceat(label, at), size)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in [*block, np.repeat(size, size)]], names)


def _leaf_pairs(num: int, den: int):
    """Pairs of groups ``token, class, label, n`` no larger than a leaf, sorted by token."""

    def of_rows(token, classes, label, n):
        found = [np.empty((0, 2), np.int64)]
        for step in range(1, LEAF):
            x, y = slice(None, -step), slice(step, None)
            ok = (token[x] == token[y]) & (label[x] != label[y]) & (den * n[x] >= num * n[y]) & (den * n[y] >= num * n[x])
            if not (token[x] == token[y]).any():
                break
            a, b = classes[x][ok], classes[y][ok]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def rows(batches):
        rest = None
        for batch in batches:
            block = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            block = block if rest is None else [np.concatenate(x) for x in zip(rest, block, strict=True)]
            last = int(np.searchsorted(block[0], block[0][-1], "left")) if len(block[0]) else 0
            rest = [x[last:] for x in block]
            yield of_rows(*(x[:last] for x in block))
        if rest is not None:
            yield of_rows(*rest)

    return rows


def _bounded(num: int, den: int):
    """The pairs ``a, b, n_a, n_b, bits_a, bits_b`` that the bound allows."""

    def rows(batches):
        for batch in batches:
            k = batch.num_rows
            sizes = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            bits = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            ok = leaf_bound(bits, sizes, np.arange(k), np.arange(k) + k, num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return rows


def _tree_pairs(num: int, den: int):
    """Pairs that the trees leave of groups ``token, class, label, n, bits``."""

    def rows(batches):
        for group in _groups(batches, 1):
            classes = group["class"].to_numpy()
            i, j = candidate_pairs(group["bits"].to_pylist(), group["n"].to_numpy(), group["label"].to_numpy(), None, num, den)
            a, b = np.minimum(classes[i], classes[j]), np.maximum(classes[i], classes[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows


def _block_links(num: int, den: int):
    """Links found in blocks ``token, i, j, side, class, label, n, bits, set``.

    Near copies meet under many tokens: a task keeps what its links have joined for its later
    groups, at most an entry per component of its rows.
    """

    def rows(batches):
        joined: dict[int, int] = {}

        def root(label: int) -> int:
            end = label
            while end in joined:
                end = joined[end]
            while label != end:  # next time in one step
                joined[label], label = end, joined[label]
            return end

        for group in _groups(batches, 3):
            classes, sets = group["class"].to_numpy(), group["set"].to_pylist()
            own, at = np.unique(group["label"].to_numpy(), return_inverse=True)
            labels = np.array([root(x) for x in own.tolist()], np.int64)[at]
            sides = group["side"].to_numpy() if group["i"][0] != group["j"][0] else None
            i, j = candidate_pairs(group["bits"].to_pylist(), group["n"].to_numpy(), labels, sides, num, den)
            links = []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if labels[x] != labels[y] and _similar(sets[x], sets[y], num, den):
                    links.append((classes[x], classes[y]))
                    joined[int(labels[y])] = int(labels[x])
                    labels[labels == labels[y]] = labels[x]
            a, b = (np.array(z, np.int64) for z in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, num: int = 75, den: int = 100
) -> DataFrame:
    """A row per document: ``id, n_shingles, class, component_id, stays`` and its address.

    Documents link when ``den * |x & y| >= num * |x | y|`` for their sets of ``n_words``-word
    shingles; ``component_id`` is the smallest id reachable by links, the document's own for one
    without words.  Documents of one ``class`` have the same set.  One document of each component
    ``stays``, that with the smallest id, then address; so does every one without words.
    """
    spark, paths = docs.sparkSession, []

    def step(df: DataFrame, label: str) -> DataFrame:
        """Stored until the documents are labelled: later joins of whole texts need the disk."""
        written, path = write_step(df, label)
        paths.append(path)
        return written

    read = addressed(docs, id_col, text_col).select(
        F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), FILE, ROW).alias("row"),
        F.col(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(shingle_levels(read, "text", n_words))  # 2 ** TABLE_BITS bytes
    row_type = read.schema["row"].dataType.simpleString()
    # prefixes are only dealt out by class once, when the first links have labelled the classes
    wide = step(read.mapInArrow(
        _class_rows(levels, n_words, num, den), f"row {row_type}, class long, n long, prefix array<long>, bits binary"), "shingles")
    levels.destroy()
    rows = step(wide.select("row", "n", "class"), "rows")
    classes = step(
        wide.filter("n > 0").groupBy("class").agg(
            F.first("n").alias("n"), F.first(F.slice("prefix", 1, FIRST)).alias("first"), F.first("bits").alias("bits")),
        "classes",
    )
    sized = classes.select("class", "n")

    # first links: each class with one class of each group of its first shingles
    near = classes.select("class", "n", F.explode("first").alias("token"))
    centre = near.groupBy("token").agg(
        F.min(F.struct(F.xxhash64("token", "class").alias("h"), F.col("class").alias("b"), F.col("n").alias("n_b"))).alias("c"),
        F.count(F.lit(1)).alias("size")).filter("size > 1").select("token", "c.b", "c.n_b")
    tries = near.join(centre, "token").filter(
        (F.col("class") != F.col("b")) & (den * F.col("n") >= num * F.col("n_b")) & (den * F.col("n_b") >= num * F.col("n"))
    ).select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()
    signed = classes.select("class", "n", "bits")

    def allowed(pairs):
        side = lambda x: signed.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(
            _bounded(num, den), "a long, b long")

    def sets_of(wanted):
        found, sent = _wanted_sets(read, "text", n_words, step(wanted.distinct(), "wanted"))
        found = step(found, "sets")
        sent.destroy()
        return found

    tries = step(allowed(tries), "tries")
    tried = len(paths)
    links = step(_checked(tries, sets_of(_classes_of(tries)), num, den), "links")
    delete_steps(spark, paths[tried:-1])
    known = stored(components(links), "components").withColumnRenamed("node", "class")

    # every prefix shingle in more than one component
    label = F.coalesce("label", "class").alias("label")
    prefixes = wide.filter("n > 0").groupBy("class").agg(F.first("prefix").alias("prefix"))
    labelled = prefixes.join(known, "class", "left").select("class", label, "prefix")
    shared = step(
        labelled.select(F.explode("prefix").alias("token"), "class", "label")
        .repartition("token").sortWithinPartitions("token")
        .mapInArrow(_crossing, "token long, class long, label long, size long"),
        "shared",
    )
    delete_steps(spark, paths[:1])  # the wide rows
    by_token = lambda rows: rows.repartition("token").sortWithinPartitions("token")
    leaves = by_token(shared.filter(F.col("size") <= LEAF).join(sized, "class").select("token", "class", "label", "n"))
    trees = by_token(shared.filter((F.col("size") > LEAF) & (F.col("size") <= LARGE)).join(signed, "class").select(
        "token", "class", "label", "n", "bits"))
    small = step(
        allowed(leaves.mapInArrow(_leaf_pairs(num, den), "a long, b long").distinct())
        .union(trees.mapInArrow(_tree_pairs(num, den), "a long, b long")).distinct(), "pairs")
    large = step(shared.filter(F.col("size") > LARGE), "large")
    sets = sets_of(_classes_of(small).union(large.select("class")))
    links = links.union(step(_checked(small, sets, num, den), "links"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks.cast("bigint")).cast("int")
    cut = (
        large.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("int").alias("side"), "class", "label")
        .join(signed, "class").join(sets, "class")
        .select("token", "i", "j", "side", "class", "label", "n", "bits", "set")
    )
    links = links.union(step(
        cut.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        .mapInArrow(_block_links(num, den), "a long, b long"), "links"))

    joined = components(links).withColumnRenamed("node", "class")
    labelled = stored(
        rows.select("row", "n", "class").join(joined, "class", "left").select("row", "n", "class", F.coalesce("label", "class").alias("label")),
        "labelled",
    )
    delete_steps(spark, paths)
    least = labelled.filter("n > 0").groupBy("label").agg(F.min("row").alias("least"))
    return labelled.join(least, "label", "left").select(
        F.col("row.id").alias(id_col), F.col("n").alias("n_shingles"), "class",
        F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("row.id")).alias("component_id"),
        ((F.col("n") == 0) | (F.col("row") == F.col("least"))).alias("stays"),
        F.col(f"row.{FILE}").alias(FILE), F.col(f"row.{ROW}").alias(ROW),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5``: every document with the component of its near copies."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_shingles", "component_id", "class")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each component."""
    docs = landed(docs)
    kept = similar_documents(docs).filter("stays").select(FILE, ROW)
    return addressed(docs, *docs.columns).join(kept, [FILE, ROW], "left_semi").select(*docs.columns)
