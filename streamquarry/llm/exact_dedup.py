"""Exact deduplication by a stateful stream.

A file stream of signatures (digest, length, id, address of the content) feeds keyed state
in RocksDB: on local disk while it runs, with checkpoints in the shared folder, without
watermark and so without expiry.  Per digest the state keeps the best row so far (its stable
identifier and the address of its content) and the number of rows.  Map-side aggregation in
front of the state makes a digest that holds a third of all rows one record per task.

A digest that was hit is then checked byte by byte: the texts of its rows are compared with
the text at the kept address.  Rows that differ, which takes a collision of the digest, are
grouped again by their full bytes.

Null texts count as empty, and empty texts equal each other.  Null ids are allowed and lose
ties.  Repeated rows are told apart by their address.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.rows import FILE, ROW, addressed, landed, shared_path, stored, text_of, without_spaces

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # bounds the native memory of all stores of one executor together
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no space is reserved ahead for each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Signature files taken into one micro-batch; the state is committed after each.
BYTES_PER_BATCH = 64 << 30


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def signatures(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_of(docs, text_col)
    return addressed(docs, id_col, text_col).select(
        digest(without_spaces(text)).alias("digest"),
        F.char_length(text).cast("bigint").alias("n"),
        F.col(id_col).alias("id"), FILE, ROW,
    )


def ingest(spark: SparkSession, folder: str, checkpoint: str, schema, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """Feed the signature files of ``folder`` that are new to the state; return the state.

    One row per digest: ``digest, n_rows, best`` with ``best`` a struct of the kept row.  Called
    again with the same checkpoint it continues where it stopped, after new files or a failure.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        order = F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("no_id"), "id", FILE, ROW)
        state = (
            spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(folder)
            .groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n_rows"))
        )
        query = (
            state.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.format("statestore").load(checkpoint)
    best, n_rows = rows.schema["value"].dataType.fieldNames()
    return rows.select(
        "key.digest", F.col(f"value.`{best}`").alias("best"), F.col(f"value.`{n_rows}`").alias("n_rows")
    )


def _verified_splits(docs: DataFrame, state: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Rows whose bytes differ from the text kept for their digest, grouped by their bytes."""
    hit = state.filter("n_rows > 1").select("digest", "best")
    norm = without_spaces(text_of(docs, text_col))
    rows = stored(
        addressed(docs, id_col, text_col)
        .select(
            digest(norm).alias("digest"), norm.alias("norm"), F.col(id_col).alias("id"), FILE, ROW,
            F.char_length(text_of(docs, text_col)).cast("bigint").alias("n"),
        )
        .join(hit, "digest")
        .withColumn("is_kept", (F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(ROW) == F.col(f"best.{ROW}")))
        .drop("best"),
        "hits",
    )
    kept = rows.filter("is_kept").select("digest", F.col("norm").alias("kept_norm"))
    return stored(
        rows.filter("not is_kept").join(kept, "digest").filter("norm <> kept_norm").drop("kept_norm", "is_kept"),
        "collisions",
    )


def dedup_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: int = BYTES_PER_BATCH,
) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, digest`` and its address.

    Texts are equal when they are the same bytes after deleting white space.  Of equal texts
    the row with the most code points stays, then the smallest id, then the first address.
    """
    spark, docs = docs.sparkSession, landed(docs)
    folder = shared_path(spark, "signatures")
    sig = signatures(docs, id_col, text_col, digest)
    sig.write.parquet(folder)
    sig = spark.read.schema(sig.schema).parquet(folder)
    state = stored(ingest(spark, folder, shared_path(spark, "dedup-state"), sig.schema, bytes_per_batch), "state")

    apart = _verified_splits(docs, state, id_col, text_col, digest)
    order = F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("no_id"), "id", FILE, ROW)
    groups = apart.groupBy("digest", "norm").agg(F.min(order).alias("own_best"), F.count(F.lit(1)).alias("own_rows"))
    apart_rows = apart.join(groups, ["digest", "norm"]).select(FILE, ROW, "own_best", "own_rows")
    moved = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("moved"))

    best = F.coalesce("own_best", "best")
    return (
        sig.join(state, "digest")
        .join(apart_rows, [FILE, ROW], "left")
        .join(moved, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            best["id"].alias("keep_id"),
            F.coalesce("own_rows", F.col("n_rows") - F.coalesce("moved", F.lit(0))).alias("group_size"),
            ((F.col(FILE) == best[FILE]) & (F.col(ROW) == best[ROW])).alias("kept"),
            "digest", FILE, ROW,
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1``: every document with the one that stays for its text."""
    found = dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: only the row that stays for each text."""
    docs = landed(docs)
    kept = dedup_exact(docs).filter("kept").select(FILE, ROW)
    return addressed(docs, *docs.columns).join(kept, [FILE, ROW], "left_semi").select(*docs.columns)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
