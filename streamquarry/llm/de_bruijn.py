"""Removal of repeated word windows by compaction of a De Bruijn graph.

An edge of the graph is a window of ``n`` words, its ends are the runs of ``n - 1`` words it joins.
Only edges that start in documents of two different ids are of use, and of each the source, its
first occurrence (smallest id, then address, then place).  Where an edge and the one before it
are always neighbours, in every document, the path does not branch: both occur equally often, one
word apart.  Such neighbours are found by joining the edges to themselves along the coordinates
of their sources, and runs of them become one path, known by its first edge.  Wherever that edge
occurs the whole path does, so a document is described by the first edges of paths it holds.  The
words of each such span are compared with those at the path's source before they are removed.

What is shuffled stays far below the windows of the corpus:

* Texts with the same words are one text: of each such group only the first row is looked at.
  Later ids of a group lose everything, equal ids share the result.
* Each window has an anchor, the least hashed run of ``ANCHOR`` words in it, which it shares with its
  neighbours and its repeats.  Only windows whose anchor is held by two ids become edges.

Tables of flags, of fixed size, tell texts which anchors, and later which first edges, are worth
sending.  A false flag costs work and changes nothing: exact joins follow.  Windows are told apart by 64-bit
hashes; a span whose words differ from those of its source, for a collision, stays.

Null and empty texts, and those of less than ``n`` words, lose nothing.  A null id counts as larger
than all others; rows of the same id, repeated rows too, do not take each other's words.  Rows
are told apart by their address.  Other columns are not read, except into the struct ``row`` of
``without_repeats``, so their names cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamquarry.llm.places import flag_table, flagged
from streamquarry.llm.rows import FILE, ROW, addressed, landed
from streamquarry.llm.textarrays import pieces, run_hashes, span_hashes, word_edges
from streamquarry.plans.workspace import delete_steps, write_step

WORDS = 13  # of a window
ANCHOR = 8  # words of an anchor
BLOCK = 1 << 16  # places of a text after which a path ends, so that one text is many groups


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # at the white space of all contracts


def _digest(words: list[bytes]) -> bytes:
    return sha256(b" ".join(words)).digest()


def _digests(batches):
    """``file, row, id`` of each text with its number of words and their digest."""
    for batch in batches:
        texts = [words_of(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array([len(w) for w in texts], pa.int64()),
             pa.array([_digest(w) for w in texts], pa.binary())], [FILE, ROW, "id", "n_words", "digest"])


def _keys(digests: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests.to_pylist()], np.int64)


def _windows(data: np.ndarray, offsets: np.ndarray, n: int):
    """``gram, text, place, anchor, hashes, bounds``: all windows, and the words they lie in."""
    starts, ends = word_edges(data, offsets)
    hashes, bounds = span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    gram = run_hashes(hashes, n)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))[: len(gram)]
    place = np.arange(len(gram)) - bounds[text]
    whole = np.flatnonzero(np.arange(len(gram)) + n <= bounds[1:][text])
    width = min(ANCHOR, n)
    small = run_hashes(hashes, width)
    anchor = small[: len(gram)].copy()
    for k in range(1, n - width + 1):
        np.minimum(anchor, small[k : k + len(gram)], out=anchor)
    return gram[whole], text[whole], place[whole], anchor[whole], hashes, bounds


def _singles(batches, copies):
    """The rows whose words no flagged group of texts may share."""
    for batch in batches:
        if copies is not None and batch.num_rows:
            keys = _keys(pa.array([_digest(words_of(t)) for t in batch.column(3).cast(pa.binary()).to_pylist()], pa.binary()))
            batch = batch.filter(pa.array(~flagged(copies.value, keys)))
        if batch.num_rows:
            yield batch


def _anchors(n: int, copies=None):
    def rows(batches):
        for batch in _singles(batches, copies):
            for start, _, data, offsets in pieces(batch.column(3)):
                _, text, _, anchor, _, _ = _windows(data, offsets, n)
                new = np.ones(len(anchor), dtype=bool)  # neighbours share their anchor
                new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), batch.column(2).take(pa.array(text[new] + start))], ["anchor", "id"])

    return rows


def _edges(n: int, anchors, copies=None):
    """``gram, near, file, row, id, pos`` of the windows with a flagged anchor.

    ``near`` names the words before and behind a window by 32 bits of their hashes, 0 for none.
    """

    def rows(batches):
        for batch in _singles(batches, copies):
            for start, _, data, offsets in pieces(batch.column(3)):
                gram, text, place, anchor, hashes, bounds = _windows(data, offsets, n)
                kept = flagged(anchors.value, anchor)
                gram, text, place = gram[kept], text[kept], place[kept]
                at = place + bounds[text]
                padded = np.concatenate([[0], (hashes >> np.uint64(32)) | np.uint64(1), [0]]).astype(np.uint64)
                before = np.where(place > 0, padded[at], np.uint64(0))
                behind = np.where(at + n < bounds[1:][text], padded[np.minimum(at + n + 1, len(padded) - 1)], np.uint64(0))
                own = pa.array(text + start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(((before << np.uint64(32)) | behind).view(np.int64)),
                     *(batch.column(i).take(own) for i in range(3)), pa.array(place.astype(np.int32))],
                    ["gram", "near", FILE, ROW, "id", "pos"])

    return rows


def _members(n: int, heads, copies=None):
    """The texts with a flagged first edge, with the hash and place of all such edges."""

    def rows(batches):
        for batch in _singles(batches, copies):
            for start, end, data, offsets in pieces(batch.column(3)):
                gram, text, place, _, _, _ = _windows(data, offsets, n)
                kept = flagged(heads.value, gram)
                gram, text, place = gram[kept], text[kept], place[kept]
                own = np.unique(text)
                ends = pa.array(np.concatenate([[0], np.searchsorted(text, own, "right")]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (gram.view(np.int64), place.astype(np.int32))]
                take = pa.array(own + start)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(4)), *lists], [FILE, ROW, "id", "text", "grams", "places"])

    return rows


def _contents(n: int):
    """``gram, length, id, content`` of the paths that have their source in a text."""

    def rows(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, paths, id_ in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(),
                                        batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                for p in paths:
                    row = (p["gram"], p["length"], id_, b" ".join(words[p["pos"] : p["pos"] + p["length"] + n - 1]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], batch.column(2).type),
                 pa.array(out[3], pa.binary())], ["gram", "length", "source", "content"])

    return rows


def _cut(n: int):
    """``file, row, n_removed, removed, kept_sha256``: spans of words taken out after comparison."""

    def rows(batches):
        for batch in batches:
            counts, spans, digests = [], [], []
            for text, found in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(text)
                gone = np.zeros(len(words) + 2, dtype=bool)  # a border at both ends
                for s in found:
                    upto = s["pos"] + s["length"] + n - 1
                    if b" ".join(words[s["pos"] : upto]) == s["content"]:
                        gone[s["pos"] + 1 : upto + 1] = True
                borders = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
                counts.append(int(gone.sum()))
                spans.append([{"first": a, "words": b - a} for a, b in borders.tolist()])
                digests.append(_digest([w for w, g in zip(words, gone[1:].tolist(), strict=False) if not g]).hex())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))), pa.array(digests, pa.string())],
                [FILE, ROW, "n_removed", "removed", "kept_sha256"])

    return rows


def _order(*more: str) -> Column:
    """Null ids behind all others, equal ids by address."""
    return F.struct(F.col("id").isNull().alias("none"), "id", FILE, ROW, *more)


def _later(id_col: str, than: str) -> Column:
    """Whether an id is larger than another; null ids are larger than all others."""
    a, b = F.col(id_col), F.col(than)
    return F.coalesce(a > b, a.isNull() & b.isNotNull())


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """A row per document: its address, ``id``, ``n_words``, ``n_removed``, the spans ``removed``
    (first word and number of words) and ``kept_sha256``, the digest of the words that stay."""
    spark = docs.sparkSession
    send, paths = spark.sparkContext.broadcast, []

    def step(df: DataFrame, label: str) -> DataFrame:
        written, path = write_step(df, label)
        paths.append(path)
        return written

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = addressed(docs, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).select(
        FILE, ROW, "id", "text")
    own = f"{FILE} long, {ROW} long, id {id_type}"

    digests = write_step(texts.mapInArrow(_digests, f"{own}, n_words long, digest binary"), "digests")[0]
    groups = write_step(
        digests.filter(F.col("n_words") >= n).groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first.*"), "copies")[0]
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    copies = send(flag_table(groups.select(key.alias("key")), "key", groups.count()))
    # the first row of every flagged group, so of some texts without copies too
    address = F.xxhash64(FILE, ROW)
    chosen = step(
        digests.mapInArrow(_of_flagged(copies), digests.schema).groupBy("digest").agg(F.min(_order()).alias("first"))
        .select("first.*").select(FILE, ROW, address.alias("key")), "firsts")
    wanted = send(flag_table(chosen, "key", chosen.count()))
    firsts = step(
        texts.select(*texts.columns, address.alias("key")).mapInArrow(_at_flagged(wanted), f"{own}, text string")
        .join(chosen.select(FILE, ROW), [FILE, ROW], "left_semi"), "first-texts")

    def scan(task, schema: str, *tables) -> DataFrame:
        return texts.mapInArrow(task(n, *tables, copies), schema).unionByName(
            firsts.mapInArrow(task(n, *tables), schema))

    held = scan(_anchors, f"anchor long, id {id_type}").groupBy("anchor").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.col("id").isNull()).alias("none"))
    anchors = step(held.filter("a < b OR (none AND a IS NOT NULL)").select("anchor"), "anchors")
    table = send(flag_table(anchors, "anchor", anchors.count()))
    edges = step(
        scan(_edges, f"gram long, near long, {own}, pos int", table).groupBy("gram").agg(
            F.min(_order("pos")).alias("first"), F.max("id").alias("b"), F.max(F.col("id").isNull()).alias("none"),
            F.min("near").alias("near"), F.max("near").alias("_near"))
        .filter("first.id < b OR (none AND first.id IS NOT NULL)")
        .select("gram", "first.id", f"first.{FILE}", f"first.{ROW}", "first.pos", (F.col("near") == F.col("_near")).alias("plain")),
        "edges")
    compacted = step(compact(edges), "paths")
    heads = send(flag_table(compacted, "gram", compacted.count()))
    members = step(scan(_members, f"{own}, text string, grams array<long>, places array<int>", heads), "members")
    sources = compacted.groupBy(FILE, ROW).agg(F.collect_list(F.struct("gram", "pos", "length")).alias("paths"))
    contents = step(
        members.select(FILE, ROW, "id", "text").join(sources, [FILE, ROW]).select("text", "paths", "id")
        .mapInArrow(_contents(n), f"gram long, length int, source {id_type}, content binary"), "contents")
    spans = (
        members.select(FILE, ROW, "id", F.explode(F.arrays_zip("grams", "places")).alias("x"))
        .select(FILE, ROW, "id", F.col("x.grams").alias("gram"), F.col("x.places").alias("pos"))
        .join(contents, "gram").filter(_later("id", "source"))
        .groupBy(FILE, ROW).agg(F.collect_list(F.struct("pos", "length", "content")).alias("spans"))
    )
    cuts = write_step(
        members.select(FILE, ROW, "text").join(spans, [FILE, ROW]).mapInArrow(
            _cut(n), f"{FILE} long, {ROW} long, n_removed long, removed array<struct<first:long,words:long>>, kept_sha256 string"),
        "cuts")[0]
    delete_steps(spark, paths)

    first = groups.select("digest", F.col("id").alias("first_id"), F.col(FILE).alias("first_file"), F.col(ROW).alias("first_row"))
    cuts = cuts.withColumnsRenamed({FILE: "first_file", ROW: "first_row"})
    copy = F.coalesce(F.col("in_group") & _later("id", "first_id"), F.lit(False))
    return (
        digests.join(first.withColumn("in_group", F.lit(True)), "digest", "left")
        .withColumn("copy", copy)
        .withColumn("first_file", F.coalesce("first_file", FILE)).withColumn("first_row", F.coalesce("first_row", ROW))
        .join(cuts, ["first_file", "first_row"], "left")
        .select(
            FILE, ROW, "id", "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copy"), F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("words"))))
            .otherwise(F.coalesce("removed", F.expr("CAST(array() AS array<struct<first:bigint,words:bigint>>)"))).alias("removed"),
            F.when(F.col("copy"), F.lit(sha256(b"").hexdigest()))
            .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        )
    )


def _of_flagged(copies):
    def rows(batches):
        for batch in batches:
            yield batch.filter(pa.array(flagged(copies.value, _keys(batch.column(4))))) if batch.num_rows else batch

    return rows


def _at_flagged(wanted):
    def rows(batches):
        for batch in batches:
            kept = batch.filter(pa.array(flagged(wanted.value, batch.column(4).to_numpy())))
            yield pa.RecordBatch.from_arrays(kept.columns[:4], [FILE, ROW, "id", "text"])

    return rows


def compact(edges: DataFrame) -> DataFrame:
    """``gram, file, row, pos, length``: paths of ``length`` edges, known by their first edge and its source.

    ``plain`` edges have the same words on both sides wherever they occur.  A plain edge whose
    source follows that of another plain edge, a word behind it, goes on its path.
    """
    before = edges.select(FILE, ROW, (F.col("pos") + 1).alias("pos"), F.col("plain").alias("_plain"))
    goes_on = F.col("plain") & F.coalesce("_plain", F.lit(False)) & (F.col("pos") % BLOCK != 0)
    joined = edges.join(before, [FILE, ROW, "pos"], "left").select(
        "gram", FILE, ROW, "pos", F.floor(F.col("pos") / BLOCK).alias("block"), goes_on.alias("goes_on"))
    path = F.sum((~F.col("goes_on")).cast("long")).over(Window.partitionBy(FILE, ROW, "block").orderBy("pos"))
    return joined.withColumn("path", path).groupBy(FILE, ROW, "block", "path").agg(
        F.min(F.struct("pos", "gram")).alias("head"), F.count(F.lit(1)).cast("int").alias("length")
    ).select("head.gram", FILE, ROW, "head.pos", "length")


def without_repeats(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """``row`` (the columns ``carry``) of each document, with its ``clean_text``: the words that stay,
    joined by blanks, and the spans ``removed``."""
    docs = landed(docs)
    found = repeats(docs, id_col, text_col, n).select(FILE, ROW, "removed")
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    read = addressed(docs, kept, F.col(f"`{text_col}`").cast("string").alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    gone = F.filter(words, lambda w, i: ~F.exists("removed", lambda s: (i >= s["first"]) & (i < s["first"] + s["words"])))
    return read.join(found.hint("merge"), [FILE, ROW]).select("row", F.concat_ws(" ", gone).alias("clean_text"), "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11``: every document's words in windows that a document of a smaller id holds too."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = """
WITH words AS (
    SELECT d.doc_id, d.row, unnest(d.words) AS word, generate_subscripts(d.words, 1) AS pos, len(d.words) AS n
    FROM (SELECT doc_id, row_number() OVER () AS row,
                 regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents) d
), windows AS (
    SELECT *, string_agg(word, ' ') OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram
    FROM words
), first AS (
    SELECT gram, min(doc_id) AS first_id FROM windows WHERE pos + 12 <= n GROUP BY gram
), judged AS (
    SELECT w.row, w.doc_id, w.word, w.pos, w.n,
           coalesce(w.pos + 12 <= w.n AND (f.first_id < w.doc_id OR (w.doc_id IS NULL AND f.first_id IS NOT NULL)), false) AS again
    FROM windows w LEFT JOIN first f ON f.gram = w.gram AND w.pos + 12 <= w.n
), covered AS (
    SELECT *, bool_or(again) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM judged
), kept AS (
    SELECT row, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS text
    FROM covered GROUP BY row
)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) d LEFT JOIN kept k ON k.row = d.row
"""
